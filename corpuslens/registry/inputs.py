"""What the registered queries ask, with the clauses each query text means."""

from __future__ import annotations

from dataclasses import dataclass

SIZE_LOW, SIZE_HIGH = 500, 5000
LINE_LITERAL = "getz"
LINE_REGEX = r"^[A-Z][a-z]+ [a-z]+ing\b"
NAME_REGEX = r"doc\d*7\.(MD|py)$"
FUZZY_WORDS = ["wiht", "chtung", "the", "getz"]


@dataclass(frozen=True)
class Clause:
    terms: tuple[str, ...]
    occur: str = "must"


@dataclass(frozen=True)
class Query:
    key: str | None
    text: str
    clauses: tuple[Clause, ...]
    k: int = 200
    case_sensitive: bool = False
    fuzzy: bool = False
    phrase: bool = False

    @property
    def kind(self) -> str:
        return "phrase" if self.phrase else "fuzzy" if self.fuzzy else "plain"

    def row(self, query_id: int) -> tuple:
        return query_id, self.text, self.case_sensitive, self.fuzzy, self.phrase, self.k


def _all(*words: str) -> tuple[Clause, ...]:
    return tuple(Clause((w,)) for w in words)


ALL_QUERIES = {
    1: Query("Q1_one_term", "the", _all("the"), k=20),
    2: Query("Q1_all_terms", "the with", _all("the", "with")),
    3: Query("Q4_phrase", "of the", (Clause(("of", "the")),), phrase=True),
    4: Query("Q2_or", "getz OR the", (Clause(("getz",), "should"), Clause(("the",), "should"))),
    5: Query("Q3_not", "the NOT with", (Clause(("the",)), Clause(("with",), "not"))),
    6: Query("Q6_case_sensitive", "The", _all("The"), case_sensitive=True),
    7: Query("Q5_fuzzy", "wiht", _all("wiht"), fuzzy=True),
    8: Query("Q4_phrase_over_fuzzy", "of the", (Clause(("of", "the")),), fuzzy=True, phrase=True),
    9: Query("Q1_repeated_term", "the the", _all("the", "the"), k=20),
    10: Query("Q1_no_match", "zzzzzz", _all("zzzzzz"), k=20),
    11: Query("Q7_split_word", "the-with", (Clause(("the", "with")),)),
    12: Query("Q5_fuzzy_all_words", "teh wiht", _all("teh", "wiht"), fuzzy=True),
    13: Query("Q2_must_or_should", "the AND with OR of NOT der-die",
              (Clause(("the",)), Clause(("with",), "should"), Clause(("of",), "should"),
               Clause(("der", "die"), "not"))),
    14: Query("Q6_case_sensitive_phrase", "The the", (Clause(("The", "the")),), phrase=True,
              case_sensitive=True),
}
