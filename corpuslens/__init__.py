"""corpuslens: catalogue, scan and rank large text corpora with Spark DataFrames."""

import sys

from pyspark import cloudpickle

from corpuslens.plans.catalogue import build_catalogue, catalogue_status, open_catalogue
from corpuslens.plans.coordinator import SearchOutcome, search
from corpuslens.plans.index import Index, build_index, open_index, save_index
from corpuslens.plans.refresh import refresh_index
from corpuslens.plans.retrieve import index_search, ranked_documents
from corpuslens.plans.scan import scan_flags, scan_search
from corpuslens.schema import SearchOptions

# What tasks run of this package travels with them, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "Index",
    "SearchOptions",
    "SearchOutcome",
    "build_catalogue",
    "build_index",
    "catalogue_status",
    "index_search",
    "open_catalogue",
    "open_index",
    "ranked_documents",
    "refresh_index",
    "save_index",
    "scan_flags",
    "scan_search",
    "search",
]
