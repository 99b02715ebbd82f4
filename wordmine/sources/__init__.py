"""Reading corpora and word lists, writing results."""

from wordmine.sources.corpus import read_corpus, read_words
from wordmine.sources.sinks import read_stages, write_ranked, write_stages, write_words

__all__ = ["read_corpus", "read_stages", "read_words", "write_ranked", "write_stages", "write_words"]
