"""Word discovery from end to end.

All plans share one shape:

1. clauses are counted, cut into n-grams and the n-grams counted; this dictionary
   is stored, since the filter of frequent words is made from it first;
2. one more grouping gives frequency and freedom of every frequent n-gram;
   this table is small next to the corpus and is written to the shared
   folder (``materialize``), as it is read several times from here on;
3. cheap rules run first, then cohesion is looked up for the words left.

The corpus is scanned once, and nothing of its size reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmine.functions.text import CJK, PAD
from wordmine.operators import filters, rules
from wordmine.operators.association import association
from wordmine.operators.clean import unify, wash
from wordmine.operators.cohesion import cohesion
from wordmine.operators.freedom import word_statistics
from wordmine.operators.lexicon import lexicon_envelope, new_words
from wordmine.operators.ngrams import corpus_ngrams, length_from_grams, padded_ngrams
from wordmine.plans.learning import Rules, rule_features, select_learnt
from wordmine.session import materialize
from wordmine.sources.sinks import write_stages

FEATURES = ["word", "freq", "freedom", "cohesion"]


def frequent_words(
    df: DataFrame,
    max_len: int,
    min_freq: int,
    ngram_len: int | None = None,
    unified: bool = False,
) -> DataFrame:
    """Step 1 and 2: ``(word, freq, right_freedom, left_freedom, freedom)``.

    ``ngram_len`` is the longest n-gram counted, by default one more than the
    longest word so that these have neighbours, too.  With ``unified`` letters
    are lower-cased and all digits written as 0-9 first.  The dictionary and the table
    are stored at once, so this and every job below run Spark jobs before they return.
    """
    if unified:
        df = unify(df, case=True, digits=True)
    grams = stored_dictionary(corpus_ngrams(df, ngram_len or max_len + 1))
    return materialize(word_statistics(grams, max_len, min_freq), stage="frequent")


def stored_dictionary(grams: DataFrame) -> DataFrame:
    """A dictionary, stored; its figures are the occurrences of all n-grams and the corpus length."""
    freq, alone = F.col("freq"), F.length("word") == 1
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return materialize(
        grams, stage="ngrams", occurrences=total(freq), characters=total(F.when(alone, freq))
    )


def total_of(frequent: DataFrame) -> Column:
    """The corpus length as a scalar subquery."""
    return length_from_grams(frequent).scalar()


def features(words: DataFrame, frequent: DataFrame, max_len: int) -> DataFrame:
    """Step 3: add cohesion to the words left over."""
    found = cohesion(
        words.select("word", "freq", "freedom"), frequent, total_of(frequent), max_len
    )
    return found.select(*FEATURES)


def discover_v1(
    df: DataFrame,
    stopwords: DataFrame,
    max_len: int = 5,
    word_filter: int = 24,
    min_freq: int = 24,
    min_cohesion: float = 20,
    min_freedom: float = 1.0,
    unified: bool = False,
) -> DataFrame:
    """Three lower limits, set by hand: ``(word, freq, cohesion, freedom)``.

    Words must be more frequent than ``word_filter`` and at least ``min_freq``.
    """
    frequent = frequent_words(df, max_len, word_filter, unified=unified)
    words = filters.candidates_v1(frequent, stopwords, max_len, word_filter)
    # The rule is one conjunction, so its cheap parts can go first.
    words = words.where(
        (F.col("freq") >= min_freq) & (F.col("freedom") >= min_freedom)
    )
    found = rules.select_all3(
        features(words, frequent, max_len), min_freq, min_cohesion, min_freedom
    )
    return found.select("word", "freq", "cohesion", "freedom")


def discover_v2(
    df: DataFrame,
    stopwords: DataFrame,
    min_freq: int = 24,
    cohesion_low: float = 20,
    cohesion_high: float = 500,
    min_freedom: float = 1.0,
    max_len: int = 5,
    unified: bool = False,
) -> DataFrame:
    """A lower limit for freedom and a band for cohesion.

    N-grams are counted up to ``max_len`` only, so words of that length have no
    neighbours and freedom 0; to find words up to five characters, pass 6.
    """
    frequent = frequent_words(df, max_len, min_freq, max_len, unified)
    words = filters.candidates_v2(frequent, stopwords, max_len, min_freq)
    words = words.where(F.col("freedom") >= min_freedom)
    return rules.select_band(
        features(words, frequent, max_len), min_freedom, cohesion_low, cohesion_high
    )


def discover_v3(
    df: DataFrame,
    stopwords: DataFrame,
    lexicon: DataFrame,
    max_len: int = 5,
    min_freq: int = 24,
    exclude_lexicon: bool = True,
    stages_dir: str | None = None,
    unified: bool = False,
    learnt: Rules | None = None,
) -> DataFrame:
    """Limits learnt from the known words found in the corpus.

    ``exclude_lexicon`` leaves the known words out of the result.  With
    ``stages_dir`` the left, right and joined freedom and all features are
    written there, too.  Given ``learnt`` rules (of ``learn_rules`` or
    ``read_rules``, on the features of ``rule_features``) these decide instead
    of the range of the known words.
    """
    frequent = frequent_words(df, max_len, min_freq, unified=unified)
    candidates = filters.candidates_v3(frequent, stopwords, max_len, min_freq)
    words = filters.positive_freedom(candidates)
    table = materialize(features(words, frequent, max_len), stage="features")
    if stages_dir is not None:
        stages = {
            "left_freedom": candidates.select("word", "freq", "left_freedom"),
            "right_freedom": candidates.select("word", "freq", "right_freedom"),
            "freedom": candidates,
            "features": table,
        }
        write_stages(stages, stages_dir)
    if learnt is None:
        found = rules.select_envelope(table, lexicon_envelope(table, lexicon))
    else:
        measured = rule_features(table, frequent, total_of(frequent), learnt.cols)
        found = select_learnt(table, measured, learnt)
    return new_words(found, lexicon) if exclude_lexicon else found


def discover_v31(
    df: DataFrame,
    stopwords: DataFrame,
    min_freq: int = 24,
    max_len: int = 5,
    min_cohesion: float = 20,
    unified: bool = False,
) -> DataFrame:
    """A lower limit for cohesion, and five association measures more.

    N-grams are counted up to ``max_len`` only (see ``discover_v2``).
    """
    frequent = frequent_words(df, max_len, min_freq, max_len, unified)
    candidates = filters.candidates_v31(frequent, stopwords, max_len, min_freq)
    words = filters.positive_freedom(candidates)
    tight = rules.select_min_cohesion(
        features(words, frequent, max_len), min_cohesion
    )
    return association(tight, frequent, total_of(frequent)).drop("ksi")


def padded_features(
    df: DataFrame,
    max_len: int = 6,
    min_freq: int = 10,
    alphabet: str = CJK,
    cap: float = 1e9,
    unified: bool = False,
) -> DataFrame:
    """Features of all frequent words of the washed texts.

    Each document is one text; its ends count as neighbours.
    """
    texts = df.select("text")
    if unified:
        texts = unify(texts, case=True, digits=True)
    grams = stored_dictionary(padded_ngrams(wash(texts, alphabet), max_len))
    frequent = materialize(word_statistics(grams, max_len, min_freq, PAD), stage="frequent")
    words = filters.by_length_freq(frequent, max_len, min_freq)
    found = cohesion(
        words.select("word", "freq", "freedom"),
        frequent,
        total_of(frequent),
        max_len,
        cap,
    )
    return found.select(*FEATURES)


def discover_padded(
    df: DataFrame,
    max_len: int = 6,
    min_freq: int = 10,
    freedom: float = 1.7,
    cohesion: float = 23,
    alphabet: str = CJK,
    unified: bool = False,
) -> DataFrame:
    """Words of washed texts whose freedom and cohesion lie above two limits.

    Order the result with ``rank_by(df, 'freq')``; scale its features with the
    functions of ``wordmine.operators.scaling``.
    """
    table = padded_features(df, max_len, min_freq, alphabet, unified=unified)
    return rules.select_strict(table, freedom, cohesion)
