"""Finding the words of a text corpus without a dictionary, on Spark."""

from wordmine.plans.discover import (
    discover_padded,
    discover_v1,
    discover_v2,
    discover_v3,
    discover_v31,
)
from wordmine.plans.index import DictionaryIndex, build_index
from wordmine.plans.learning import apply_rules, learn_rules, read_rules, write_rules
from wordmine.plans.store import DictionaryStore
from wordmine.sources import (
    read_corpus,
    read_stages,
    read_words,
    write_ranked,
    write_stages,
    write_words,
)

__all__ = [
    "DictionaryIndex",
    "DictionaryStore",
    "apply_rules",
    "build_index",
    "discover_padded",
    "discover_v1",
    "discover_v2",
    "discover_v3",
    "discover_v31",
    "learn_rules",
    "read_corpus",
    "read_rules",
    "read_stages",
    "read_words",
    "write_ranked",
    "write_rules",
    "write_stages",
    "write_words",
]
