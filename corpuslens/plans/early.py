"""Which words must lead a query, so that its best k documents are found without the others.

Only queries whose clauses may all be missing (OR) are looked at here: with a word that must be
there, its documents are all that can match. The score is
``matched / counted * sum(weight * sqrt(tf)) * norm``. No document has more of a word than
``weight * top``, ``top`` being kept in the vocabulary, so that a document with none of the
leading clauses scores at most ``left / counted * sum(their bounds)``.

All of this works on the rows of the query terms; the postings are read by ``plans/retrieve.py``.
"""

from __future__ import annotations

from collections import defaultdict

from corpuslens.functions.scoring import SCORE_PLACES

# The rarest clauses lead at first, until they have so many documents for each hit asked for.
DOCS_PER_HIT = 2
# Sums of doubles may differ in their last places with the order of their parts.
SLACK = 1 + 1e-9


def _clauses(rows: list[dict]) -> dict[int, dict[int, list[dict]]]:
    """Rows by query and clause, of queries of two or more plain clauses, none of which must be
    there. Clauses that must not be there take no part."""
    queries: dict[int, dict[int, list[dict]]] = defaultdict(lambda: defaultdict(list))
    for r in rows:
        if not r["n_must"] and r["kind"] == "plain" and r["is_should"]:
            queries[r["query_id"]][r["slot"]].append(r)
    return {q: slots for q, slots in queries.items() if len(slots) > 1}


def _rarest(tokens: list[dict]) -> dict:
    """The token that leads a clause; all of its tokens must be there for it to match."""
    return min(tokens, key=lambda r: (r["df"], r["term"]))


def _bound(slots: list[list[dict]], counted: int) -> float:
    """The most that a document can score with these clauses alone."""
    most = sum(r["weight"] * r["top"] for tokens in slots for r in tokens)
    return round(len(slots) / counted * most * SLACK, SCORE_PLACES)


def _led_by(rows: list[dict], leading: dict[int, set[int]]) -> list[dict]:
    """The rows, with the clauses ``leading`` (by query) as leads of these queries."""
    led = {(q, slot): _rarest(tokens)["term"] for q, slots in _clauses(rows).items()
           if q in leading for slot, tokens in slots.items() if slot in leading[q]}
    return [r if r["query_id"] not in leading else
            {**r, "lead": led.get((r["query_id"], r["slot"])) == r["term"]} for r in rows]


def probe(rows: list[dict] | None) -> list[dict] | None:
    """The rows, with the rarest clauses of each OR query as its leads; None if nothing is left
    out by that."""
    leading = {}
    for query_id, slots in _clauses(rows or []).items():
        docs, chosen = 0, set()
        for slot in sorted(slots, key=lambda s: (_rarest(slots[s])["df"], s)):
            tokens = slots[slot]
            if docs >= DOCS_PER_HIT * tokens[0]["k"]:
                break
            docs += _rarest(tokens)["df"]
            chosen.add(slot)
        if len(chosen) < len(slots):
            leading[query_id] = chosen
    return _led_by(rows, leading) if leading else None


def undecided(rows: list[dict], hits: list[dict]) -> list[dict]:
    """The rows of queries whose hits are not final, led by all clauses that must lead.

    With the k-th score found, the clauses with the smallest bounds are left out as long as they
    cannot reach it together; fewer than k hits leave out none.
    """
    scores = defaultdict(list)
    for hit in hits:
        scores[hit["query_id"]].append(hit["score"])
    leading = {}
    for query_id, slots in _clauses(rows).items():
        first = next(iter(slots.values()))[0]
        now = {slot for slot, tokens in slots.items() if any(r["lead"] for r in tokens)}
        found = scores[query_id]
        least = min(found) if len(found) >= first["k"] > 0 else 0.0
        counted = first["n_counted"]
        needless: list[int] = []
        for slot in sorted(slots, key=lambda s: _bound([slots[s]], counted)):
            if _bound([slots[s] for s in [*needless, slot]], counted) >= least:
                break
            needless.append(slot)
        left_out = [slots[s] for s in slots if s not in now]
        if _bound(left_out, counted) >= least and first["k"] > 0:
            leading[query_id] = set(slots) - set(needless)
    again = _led_by(rows, leading)
    return [r for r in again if r["query_id"] in leading]


__all__ = ["probe", "undecided"]
