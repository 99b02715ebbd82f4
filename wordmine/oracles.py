"""The queries of ``wordmine.queries`` as SQL for DuckDB.

The SQL is written independently of the DataFrame code: it counts every clause
and every n-gram position by position, takes entropies in two passes straight
from the definition, and finds neighbours on the left from reversed text in the
padded variant.
"""

from __future__ import annotations

from wordmine.queries import (
    COHESION_HIGH,
    COHESION_LOW,
    GROWN_DEPTH,
    LATIN,
    MAX_LEN,
    MIN_FREEDOM,
    MIN_FREQ,
    PADDED_FREQ,
    PADDED_LEN,
    RULE_DEPTH,
    SCORE_WEIGHTS,
    STOPWORD_FREQ,
    TOP,
)

# Fixed values, written out here again so that a slip in the code would show.
CLAUSE_MARKS = ",，.。!！?？;；:：'‘’\"”“、(（)）<《>》[【】]{} \t\r\n"
OTHER_DIGITS = "０１２３４５６７８９〇零一二三四五六七八九"
PLAIN_DIGITS = "012345678900123456789"
PAD = "\u0001"


def _text(value: str) -> str:
    """A SQL string literal; control characters are written as chr()."""
    out = "'" + value.replace("'", "''") + "'"
    for c in sorted({c for c in value if ord(c) < 32}):
        out = out.replace(c, f"'||chr({ord(c)})||'")
    return f"({out})"


# A decimal point is hidden as chr(1) while the text is split.  The pattern
# runs twice, because 1.2.3 holds two points that share a digit.
_MARKS = _text(
    "[" + "".join("\\" + c if c in "[]{}()<>.?!" else c for c in CLAUSE_MARKS) + "]"
)
_DROPPED = r"('[^'||chr(1)||chr(10)||'一-龥a-zA-Z0-9*\-.\\]')"
_SPECIAL = r"'\\r\\n|\\n|\\t|[0-9]{8,}'"


def _hidden(text: str) -> str:
    point = r"'(\p{Nd})\.(\p{Nd})', '\1'||chr(1)||'\2', 'g'"
    return f"regexp_replace(regexp_replace({text}, {point}), {point})"


def _marked(text: str) -> str:
    return f"regexp_replace({_hidden(text)}, {_MARKS}, chr(10), 'g')"


def _kept(text: str) -> str:
    return (
        f"replace(regexp_replace({_marked(text)}, {_DROPPED}, '', 'g'), chr(1), '.')"
    )


def _clause_list(text: str) -> str:
    pieces = f"string_split_regex({_kept(text)}, chr(10)||'|'||{_SPECIAL})"
    return f"[p for p in {pieces} if p <> '']"


def _short_clauses(table: str) -> str:
    return f"""
        SELECT word, count(*) AS n
        FROM (SELECT unnest({_clause_list('text')}) AS word FROM {table})
        WHERE length(word) BETWEEN 2 AND {MAX_LEN} GROUP BY word"""


_IS_CANDIDATE = f"length(word) BETWEEN 2 AND {MAX_LEN} AND freq >= {MIN_FREQ}"


def _entropy_sql(source: str, key: str, name: str) -> str:
    return f"""
        SELECT word, CASE WHEN count(*) = 1 THEN 0.0
               ELSE round(-sum(p * ln(p)), 9) END AS {name}
        FROM (SELECT {key} AS word,
                     freq / sum(freq) OVER (PARTITION BY {key}) AS p
              FROM {source} WHERE length(word) > 1)
        GROUP BY word"""


def _freedom_sql(grams: str) -> str:
    return f"""
        SELECT g.word, g.freq,
               coalesce(r.right_freedom, 0.0) AS right_freedom,
               coalesce(l.left_freedom, 0.0) AS left_freedom,
               least(coalesce(r.right_freedom, 0.0),
                     coalesce(l.left_freedom, 0.0)) AS freedom
        FROM {grams} g
        LEFT JOIN ({_entropy_sql(grams, _RIGHT, 'right_freedom')}) r USING (word)
        LEFT JOIN ({_entropy_sql(grams, _LEFT, 'left_freedom')}) l USING (word)
        WHERE length(g.word) > 1"""


_RIGHT = "substr(word, 1, length(word) - 1)"
_LEFT = "substr(word, 2)"


def _splits(words: str) -> str:
    return f"""
        SELECT w.word, w.freq, k, substr(w.word, 1, k) AS lp, substr(w.word, k + 1) AS rp
        FROM {words} w, unnest(range(1, length(w.word))) AS s(k)"""


def _cohesion_sql(words: str, grams: str, total: str) -> str:
    return f"""
        SELECT s.word, s.freq,
               min(s.freq::DOUBLE * (SELECT total FROM {total})
                   / lg.freq / rg.freq) AS cohesion
        FROM ({_splits(words)}) s
        JOIN {grams} lg ON lg.word = s.lp
        JOIN {grams} rg ON rg.word = s.rp
        GROUP BY s.word, s.freq"""


def _grams_sql(source: str, n: int) -> str:
    return f"""
        SELECT substr(clause, i, k) AS word, sum(w)::BIGINT AS freq
        FROM (SELECT clause, count(*) AS w FROM {source} GROUP BY clause),
             unnest(range(1, length(clause) + 1)) AS a(i),
             unnest(range(1, least({n}, length(clause) - i + 1) + 1)) AS b(k)
        GROUP BY 1"""


def _padded_side(name: str) -> str:
    """Entropy of the following character; a text end counts as one."""
    return f"""
        SELECT word, CASE WHEN count(*) = 1 THEN 0.0
               ELSE round(-sum(p * ln(p)), 9) END AS {name}
        FROM (SELECT word, n / sum(n) OVER (PARTITION BY word) AS p
              FROM (SELECT substr(s, 1, k) AS word, substr(s, k + 1, 1) AS nxt,
                           sum(c) AS n
                    FROM {name}_shingles, unnest(range(2, {PADDED_LEN + 1})) AS b(k)
                    WHERE substr(s, k, 1) <> chr({ord(PAD)})
                    GROUP BY 1, 2))
        GROUP BY word"""


def _shingles_sql(neighbour: str) -> str:
    """The character at each position and the next PADDED_LEN on one side."""
    more = " || ".join(
        f"coalesce({neighbour}(ch, {i}) OVER w, chr({ord(PAD)}))"
        for i in range(1, PADDED_LEN + 1)
    )
    return f"""
        SELECT doc_id, ch || {more} AS s
        FROM (SELECT doc_id, unnest(range(length(text))) AS i,
                     unnest(string_split(text, '')) AS ch
              FROM washed WHERE text <> '')
        WINDOW w AS (PARTITION BY doc_id ORDER BY i)"""


# Common table expressions, each with the ones it reads.  "!" marks those that
# several others read.
_PARTS: dict[str, tuple[str, str]] = {
    "clause_rows": (
        "",
        f"""
        SELECT doc_id, unnest(range(len(l)))::INTEGER AS pos, unnest(l) AS clause
        FROM (SELECT doc_id, {_clause_list('text')} AS l FROM documents)""",
    ),
    "stops": (
        "",
        f"""
        SELECT word FROM ({_short_clauses('conversations')})
        WHERE n >= {STOPWORD_FREQ}""",
    ),
    "lex": ("", f"SELECT word FROM ({_short_clauses('benchmark')}) WHERE n >= 3"),
    "grams": ("clause_rows", _grams_sql("clause_rows", MAX_LEN + 1)),
    "grams_short": ("clause_rows", _grams_sql("clause_rows", MAX_LEN)),
    "tl": (
        "clause_rows",
        "SELECT coalesce(sum(length(clause)), 0)::BIGINT AS total FROM clause_rows",
    ),
    "free": ("grams", _freedom_sql("grams")),
    "free_short": ("grams_short", _freedom_sql("grams_short")),
    "cand": ("grams", f"SELECT word, freq FROM grams WHERE {_IS_CANDIDATE}"),
    "coh": ("cand grams tl", _cohesion_sql("cand", "grams", "tl")),
    "coh_short": (
        "grams_short tl cand_short",
        _cohesion_sql("cand_short", "grams_short", "tl"),
    ),
    "cand_short": (
        "grams_short",
        f"SELECT word, freq FROM grams_short WHERE {_IS_CANDIDATE}",
    ),
    "feat_all": (
        "free coh",
        "SELECT word, coh.freq, freedom, cohesion FROM coh JOIN free USING (word)",
    ),
    "feat": ("feat_all", "SELECT * FROM feat_all WHERE freedom > 0"),
    "feat_short": (
        "free_short coh_short",
        """
        SELECT word, c.freq, freedom, cohesion
        FROM coh_short c JOIN free_short USING (word)""",
    ),
    "env": (
        "feat lex",
        """
        SELECT min(freedom) AS freedom_low, max(freedom) AS freedom_high,
               min(cohesion) AS cohesion_low, max(cohesion) AS cohesion_high
        FROM feat WHERE word IN (SELECT word FROM lex)""",
    ),
    "chars": (
        "grams",
        """
        SELECT c.word, any_value(c.freq) AS freq, sum(u.freq)::DOUBLE AS s,
               product(u.freq) AS p, length(c.word) AS n
        FROM (SELECT word, freq, unnest(string_split(word, '')) AS ch FROM cand) c
        JOIN grams u ON u.word = c.ch GROUP BY c.word""",
    ),
    "measures": (
        "cand chars tl",
        """
        SELECT word, freq, n, s, p, t, p / pow(t, n - 1) AS ksi
        FROM chars, (SELECT total::DOUBLE AS t FROM tl)""",
    ),
    "chosen": (
        "feat",
        f"""
        SELECT * FROM feat WHERE freq >= {MIN_FREQ}
        AND cohesion >= {COHESION_LOW} AND freedom >= {MIN_FREEDOM}""",
    ),
    "washed": (
        "",
        f"""
        SELECT doc_id, regexp_replace(text, '[^{LATIN}]', '', 'g') AS text
        FROM documents""",
    ),
    "shingle_rows": ("washed", _shingles_sql("lead")),
    "right_freedom_shingles": (
        "shingle_rows",
        "SELECT s, count(*) AS c FROM shingle_rows GROUP BY s",
    ),
    "left_freedom_shingles": (
        "washed",
        "SELECT s, count(*) AS c FROM "
        f"({_shingles_sql('lag')}) GROUP BY s",
    ),
    "pgrams": (
        "right_freedom_shingles",
        f"""
        SELECT substr(s, 1, k) AS word, sum(c)::BIGINT AS freq
        FROM right_freedom_shingles, unnest(range(1, {PADDED_LEN + 1})) AS b(k)
        WHERE substr(s, k, 1) <> chr({ord(PAD)}) GROUP BY 1""",
    ),
    "pcand": (
        "pgrams",
        f"""
        SELECT word, freq FROM pgrams
        WHERE length(word) > 1 AND freq >= {PADDED_FREQ}""",
    ),
    "ptl": ("washed", "SELECT sum(length(text)) AS total FROM washed"),
    "pfree": (
        "pcand right_freedom_shingles left_freedom_shingles",
        f"""
        SELECT word, freq, right_freedom, left_freedom,
               least(right_freedom, left_freedom) AS freedom
        FROM pcand JOIN ({_padded_side('right_freedom')}) USING (word)
        JOIN (SELECT reverse(word) AS word, left_freedom
              FROM ({_padded_side('left_freedom')})) USING (word)""",
    ),
    "pcoh": (
        "pcand pgrams ptl",
        f"""
        SELECT word, freq, least(1e9, cohesion) AS cohesion
        FROM ({_cohesion_sql('pcand', 'pgrams', 'ptl')})""",
    ),
}


def _with(needs: str, body: str) -> str:
    todo, seen = needs.split(), set()
    while todo:
        name = todo.pop()
        if name not in seen:
            seen.add(name)
            todo += _PARTS[name][0].split()
    done: list[str] = []
    while len(done) < len(seen):
        done += [
            n
            for n in _PARTS
            if n in seen
            and n not in done
            and all(d in done for d in _PARTS[n][0].split())
        ]
    parts = [f"{n} AS MATERIALIZED ({_PARTS[n][1]})" for n in done]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def _rounded(cols: str) -> str:
    """``a, b, *c`` -> a, b as they are, c rounded."""
    out = []
    for c in cols.split():
        out.append(f"round({c[1:]}, 6) AS {c[1:]}" if c[0] == "*" else c)
    return ", ".join(out)


_FEATURES = _rounded("word freq *freedom cohesion")
_STOPPED = "word NOT IN (SELECT word FROM stops)"
_STRICT = f"length(word) BETWEEN 2 AND {MAX_LEN} AND freq > {MIN_FREQ}"
_NO_DIGITS = "NOT regexp_matches(word, '^[0-9]+$')"


def _edges(marks: str) -> str:
    sides = [f"{f}(word, '{m}')" for m in marks for f in ("starts_with", "ends_with")]
    return f"NOT ({' OR '.join(sides)})"


def _where(source: str, condition: str) -> str:
    return f"SELECT word, freq FROM {source} WHERE {condition}"


def _pick(condition: str, source: str = "feat") -> str:
    return f"SELECT {_FEATURES} FROM {source} WHERE {condition}"


_BAND = (
    f"freedom >= {MIN_FREEDOM} "
    f"AND cohesion BETWEEN {COHESION_LOW} AND {COHESION_HIGH}"
)


def _in_limits(source: str) -> str:
    """Within the range of the known words; each limit is a subquery of one value."""
    known = f"FROM {source} WHERE word IN (SELECT word FROM lex)"
    return " AND ".join(
        f"{c} >= (SELECT min({c}) {known}) AND {c} <= (SELECT max({c}) {known})"
        for c in ("freedom", "cohesion")
    )


_ALL3 = (
    f"freq >= {MIN_FREQ} AND cohesion >= {COHESION_LOW} AND freedom >= {MIN_FREEDOM}"
)
_VOTE = f"""
    (freq >= 1000)::INT + (freedom >= {MIN_FREEDOM})::INT
    + (cohesion > {COHESION_LOW} AND cohesion < {COHESION_HIGH})::INT >= 2"""


def _counted(pieces: str) -> str:
    return f"""
        SELECT clause, count(*) AS n FROM (SELECT unnest({pieces}) AS clause
        FROM documents) WHERE clause <> '' GROUP BY clause"""


_SCALED_COLS = ("freq", "freedom", "cohesion")


def _moment_row() -> str:
    cols = []
    for c in _SCALED_COLS:
        cols.append(f"avg({c}) AS {c}_mean")
        cols.append(
            f"sqrt(sum(({c} - (SELECT avg({c}) FROM chosen)) ** 2)) / count(*) "
            f"AS {c}_spread"
        )
    return f"SELECT {', '.join(cols)} FROM chosen"


def _scaled(how: str) -> str:
    cols = ", ".join(f"round({how.format(c=c)}, 6) AS {c}" for c in _SCALED_COLS)
    return f"SELECT word, {cols} FROM chosen, ({_moment_row()})"


_ZSCALED = "({c} - {c}_mean) / nullif({c}_spread, 0)"


def _unit(c: str) -> str:
    low, high = (f"(SELECT {f}({c}) FROM chosen)" for f in ("min", "max"))
    return f"(({c} - {low}) / nullif({high} - {low}, 0))"


def _unit_row(f: str) -> str:
    cols = [f"round({f.format(_unit(c))}, 6) AS {c}" for c in _SCALED_COLS]
    return f"SELECT word, {', '.join(cols)} FROM chosen"


def _score_sql() -> str:
    terms = " + ".join(
        f"{w} * {_unit(f'ln(1 + {c})')}" for c, w in SCORE_WEIGHTS.items()
    )
    return f"SELECT word, round({terms}, 6) AS score FROM chosen"


def _ranked(col: str, shown: str) -> str:
    return f"""
        SELECT row_number() OVER (ORDER BY {col} DESC, word) AS rank, word, {shown}
        FROM feat"""


def _measure(expr: str, name: str, log: bool = False) -> str:
    more = f", round(ln({expr}), 6) AS ln_{name}" if log else ""
    return _with(
        "measures", f"SELECT word, round({expr}, 6) AS {name}{more} FROM measures"
    )


_MI = "(ln(freq / p / t) + n * ln(t))"
_SCP = "(pow(freq, n) / p)"
_Z = "((freq - ksi) / nullif(sqrt(ksi * (1 - ksi / t)), 0))"
_T = "((freq - ksi) / nullif(sqrt(freq * (1 - freq / t)), 0))"
_DICE = "(n * freq / s)"


def _extension(stem: str) -> str:
    return f"""
        SELECT word, extension, extension_freq
        FROM (SELECT {stem} AS word, word AS extension, freq AS extension_freq
              FROM grams WHERE length(word) > 2)
        JOIN (SELECT word FROM cand) USING (word)"""


def all_oracles() -> dict[str, str]:
    """Query name -> SQL."""
    return {
        "scan_corpus": "SELECT doc_id, text FROM documents",
        "scan_stopwords": _with("stops", "SELECT word FROM stops"),
        "scan_lexicon": _with("lex", "SELECT word FROM lex"),
        "clause_split": _counted(
            f"string_split(replace({_marked('text')}, chr(1), '.'), chr(10))"
        ),
        "meaningful_chars": r"""
            SELECT doc_id,
                   regexp_replace(text, '[^一-龥a-zA-Z0-9*\-.\\]', '', 'g') AS text
            FROM documents""",
        "escape_split": _counted(
            f"string_split_regex({_kept('text')}, "
            r"chr(10)||'|\\r\\n|\\n|\\t')"
        ),
        "long_digit_split": _counted(
            f"string_split_regex({_kept('text')}, chr(10)||'|[0-9]{{8,}}')"
        ),
        "clauses": _with("clause_rows", "SELECT doc_id, pos, clause FROM clause_rows"),
        "scan_corpus_text": """
            SELECT text, count(*) AS n
            FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM documents)
            GROUP BY text""",
        "scan_corpus_gbk": _on_cjk("""
            SELECT text, count(*) AS n
            FROM (SELECT regexp_replace(line, '[^ -~一-龥]', '', 'g') AS text
                  FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents))
            WHERE text <> '' GROUP BY text"""),
        "sink_words": _with("cand", "SELECT word, freq FROM cand"),
        "sink_stages": _with(
            "cand grams",
            """
            SELECT word, freq, 'words' AS stage FROM cand UNION ALL
            SELECT word, freq, 'characters' FROM grams WHERE length(word) = 1""",
        ),
        "sink_ranked": _with(
            "cand",
            "SELECT row_number() OVER (ORDER BY freq DESC, word) AS rank, word, freq FROM cand",
        ),
        "clauses_cjk": _on_cjk(
            _with("clause_rows", "SELECT doc_id, pos, clause FROM clause_rows")
        ),
        "ngram_freq_cjk": _on_cjk(
            _with("clause_rows", f"SELECT word, freq FROM ({_grams_sql('clause_rows', 3)})")
        ),
        "discover_padded_cjk": _on_cjk(
            _with("pfree pcoh", _PADDED_RULE).replace(f"[^{LATIN}]", "[^一-龥]")
        ),
        "top_freedom": _with(
            "feat",
            f"{_ranked('freedom', 'round(freedom, 6) AS freedom')} ORDER BY rank LIMIT {TOP}",
        ),
        "top_freq": _with(
            "cand",
            f"""
            SELECT row_number() OVER (ORDER BY freq DESC, word) AS rank, word, freq
            FROM cand ORDER BY rank LIMIT {TOP}""",
        ),
        "corpus_figures": _with(
            "grams tl",
            """
            SELECT count(*) AS kinds, sum(freq)::BIGINT AS occurrences,
                   (SELECT total FROM tl) AS characters FROM grams""",
        ),
        "learn_rules": _rules_sql(RULE_DEPTH),
        "learn_rules_pruned": _rules_sql(
            GROWN_DEPTH,
            more=_pruned_sql(GROWN_DEPTH),
            body=" SELECT word, label, prediction FROM decided",
        ),
        "learnt_rules_stored": _rules_sql(
            GROWN_DEPTH,
            more=(*_pruned_sql(GROWN_DEPTH), *_stored_rules_sql(GROWN_DEPTH)),
            body=_STORED_RULES,
        ),
        "discover_v3_learnt": _rules_sql(
            GROWN_DEPTH,
            "feat measures lex stops",
            _pruned_sql(GROWN_DEPTH),
            f"""
            SELECT {_FEATURES} FROM feat
            WHERE word IN (SELECT word FROM decided WHERE prediction = 1) AND {_STOPPED}
              AND word NOT IN (SELECT word FROM lex)""",
        ),
        "wash_cjk": _on_cjk("""
            SELECT doc_id, regexp_replace(text, '[^一-龥]', '', 'g') AS text
            FROM documents"""),
        "wash_latin": _with("washed", "SELECT doc_id, text FROM washed"),
        "unify_text": _on_cjk(f"""
            SELECT doc_id,
                   translate(lower(text), '{OTHER_DIGITS}', '{PLAIN_DIGITS}') AS text
            FROM documents"""),
        "ngrams": _with(
            "clause_rows",
            f"""
            SELECT doc_id, size, sum(n)::BIGINT AS occurrences, count(*) AS kinds,
                   sum(n * ('0x' || substr(md5(word), 1, 7))::BIGINT)::BIGINT AS digest
            FROM (SELECT doc_id, substr(clause, i, k) AS word, k::INTEGER AS size,
                         count(*) AS n
                  FROM clause_rows, unnest(range(1, length(clause) + 1)) AS a(i),
                       unnest(range(1, least({MAX_LEN + 1},
                                             length(clause) - i + 1) + 1)) AS b(k)
                  GROUP BY 1, 2, 3)
            GROUP BY 1, 2""",
        ),
        "shingles": _with(
            "shingle_rows",
            """
            SELECT doc_id, sum(n)::BIGINT AS occurrences, count(*) AS kinds,
                   sum(n * n)::BIGINT AS squares,
                   sum(n * ('0x' || substr(md5(s), 1, 7))::BIGINT)::BIGINT AS digest
            FROM (SELECT doc_id, s, count(*) AS n FROM shingle_rows GROUP BY 1, 2)
            GROUP BY 1""",
        ),
        "reverse_ngrams": _with(
            "grams", "SELECT reverse(word) AS word, freq FROM grams"
        ),
        "ngram_freq": _with("grams", "SELECT word, freq FROM grams"),
        "ngram_freq_increments": _with("grams", "SELECT word, freq FROM grams"),
        "shingle_freq": _with("pcand", "SELECT word, freq FROM pcand"),
        "corpus_length": _with("tl", "SELECT total FROM tl"),
        "unigrams": _with("grams", _where("grams", "length(word) = 1")),
        "total_occurrences": _with(
            "grams", "SELECT sum(freq)::BIGINT AS occurrences FROM grams"
        ),
        "right_freedom": _with(
            "grams",
            "SELECT word, round(right_freedom, 6) AS right_freedom FROM "
            f"({_entropy_sql('grams', _RIGHT, 'right_freedom')})",
        ),
        "left_freedom": _with(
            "grams",
            "SELECT word, round(left_freedom, 6) AS left_freedom FROM "
            f"({_entropy_sql('grams', _LEFT, 'left_freedom')})",
        ),
        "freedom": _with(
            "free",
            f"SELECT {_rounded('word freq *right_freedom *left_freedom *freedom')} "
            f"FROM free WHERE {_IS_CANDIDATE}",
        ),
        "freedom_indexed": _with(
            "free",
            f"SELECT {_rounded('word freq *right_freedom *left_freedom *freedom')} "
            f"FROM free WHERE {_IS_CANDIDATE}",
        ),
        "freedom_padded": _with(
            "pfree",
            f"SELECT {_rounded('word freq *right_freedom *left_freedom *freedom')} "
            "FROM pfree",
        ),
        "extensions_right": _with("cand grams", _extension(_RIGHT)),
        "extensions_indexed": _with("cand grams", _extension(_RIGHT)),
        "extensions_left": _with("cand grams", _extension(_LEFT)),
        **dict.fromkeys(
            ("part_freq", "part_freq_indexed"),
            _with(
                "cand grams",
                f"""
                SELECT s.word, s.freq, s.k::INTEGER AS k, s.side, s.part,
                       g.freq AS part_freq
                FROM (SELECT word, freq, k, 'left' AS side, lp AS part
                      FROM ({_splits('cand')})
                      UNION ALL
                      SELECT word, freq, k, 'right', rp FROM ({_splits('cand')})) s
                JOIN grams g ON g.word = s.part""",
            ),
        ),
        "cohesion": _with("coh", "SELECT word, freq, cohesion FROM coh"),
        "cohesion_indexed": _with("coh", "SELECT word, freq, cohesion FROM coh"),
        "cohesion_capped": _with("pcoh", "SELECT word, freq, cohesion FROM pcoh"),
        "features_v1": _with(
            "feat_all stops", _pick(f"freq > {MIN_FREQ} AND {_STOPPED}", "feat_all")
        ),
        "filter_len_freq_strict": _with("grams", _where("grams", _STRICT)),
        "filter_len_freq": _with("cand", "SELECT word, freq FROM cand"),
        "filter_edge_marks": _with("grams", _where("grams", _edges(".-*"))),
        "filter_edge_marks_31": _with("grams", _where("grams", _edges(".-"))),
        "filter_all_digits": _with("grams", _where("grams", _NO_DIGITS)),
        "filter_free_words": _with(
            "free",
            f"SELECT word, freq, round(freedom, 6) AS freedom FROM free "
            f"WHERE {_IS_CANDIDATE} AND freedom > 0",
        ),
        "stopword_anti": _with("grams stops", _where("grams", _STOPPED)),
        "candidates_v1": _with(
            "grams stops", _where("grams", f"{_STRICT} AND {_STOPPED}")
        ),
        "candidates_v2": _with(
            "cand stops",
            _where("cand", f"{_STOPPED} AND {_edges('.-*')} AND {_NO_DIGITS}"),
        ),
        "candidates_v3": _with("cand stops", _where("cand", _STOPPED)),
        "candidates_v31": _with(
            "grams stops",
            _where(
                "grams", f"{_STRICT} AND {_STOPPED} AND {_edges('.-')} AND {_NO_DIGITS}"
            ),
        ),
        "lexicon_semi": _with("feat lex", _pick("word IN (SELECT word FROM lex)")),
        "lexicon_anti": _with("feat lex", _pick("word NOT IN (SELECT word FROM lex)")),
        "lexicon_envelope": _with(
            "env",
            "SELECT "
            + _rounded("*freedom_low *freedom_high cohesion_low cohesion_high")
            + " FROM env",
        ),
        "rule_all3": _with("feat", _pick(_ALL3)),
        "rule_band": _with("feat", _pick(_BAND)),
        "rule_envelope": _with("feat lex", _pick(_in_limits("feat"))),
        "rule_min_cohesion": _with("feat", _pick(f"cohesion >= {COHESION_LOW}")),
        "rule_strict": _with("feat", _pick("freedom > 1.7 AND cohesion > 23")),
        "rule_vote": _with("feat", _pick(_VOTE)),
        "assoc_ksi": _measure("ksi", "ksi", log=True),
        "assoc_dice": _with("measures", f"SELECT word, {_DICE} AS dice FROM measures"),
        "assoc_mi": _measure(_MI, "mi"),
        "assoc_scp": _measure(_SCP, "scp", log=True),
        "assoc_zscore": _measure(_Z, "zscore"),
        "assoc_tscore": _measure(_T, "tscore"),
        "feature_moments": _with(
            "chosen",
            "SELECT "
            + _rounded(
                " ".join(f"*{c}_mean *{c}_spread" for c in _SCALED_COLS)
            )
            + f" FROM ({_moment_row()})",
        ),
        "scale_z": _with("chosen", _scaled(_ZSCALED)),
        "scale_minmax": _with("chosen", _unit_row("{}")),
        "scale_squash": _with("chosen", _unit_row("(1 - exp(-{}))")),
        "score_weighted": _with("chosen", _score_sql()),
        "rank_freq": _with("feat", _ranked("freq", "freq")),
        "rank_cohesion": _with(
            "feat", _ranked("cohesion", "cohesion")
        ),
        "rank_freedom": _with(
            "feat", _ranked("freedom", "round(freedom, 6) AS freedom")
        ),
        "discover_v1": _with(
            "feat_all stops",
            _pick(f"freq > {MIN_FREQ} AND {_STOPPED} AND {_ALL3}", "feat_all"),
        ),
        "discover_v2": _with(
            "feat_short stops",
            _pick(
                f"{_STOPPED} AND {_edges('.-*')} AND {_NO_DIGITS} AND {_BAND}",
                "feat_short",
            ),
        ),
        # The limits are learnt after the stopwords are gone.
        "discover_v3": _with(
            "feat lex stops", _envelope_job("AND word NOT IN (SELECT word FROM lex)")
        ),
        "discover_v3_literal": _with("feat lex stops", _envelope_job("")),
        "discover_v31": _with(
            "feat_short measures stops",
            f"""
            SELECT word, freq, round(freedom, 6) AS freedom, cohesion,
                   {_DICE} AS dice, round({_MI}, 6) AS mi,
                   round({_SCP}, 6) AS scp, round({_Z}, 6) AS zscore,
                   round({_T}, 6) AS tscore
            FROM feat_short JOIN measures USING (word, freq)
            WHERE freq > {MIN_FREQ} AND freedom > 0 AND cohesion >= {COHESION_LOW}
              AND {_STOPPED} AND {_edges('.-')} AND {_NO_DIGITS}""",
        ),
        "discover_padded": _with("pfree pcoh", _PADDED_RULE),
    }


_PADDED_RULE = """
    SELECT word, pfree.freq, round(freedom, 6) AS freedom, cohesion
    FROM pfree JOIN pcoh USING (word)
    WHERE freedom > 1.7 AND cohesion > 23"""


def _on_cjk(sql: str) -> str:
    """The same SQL on documents written in CJK characters."""
    letters = "abcdefghijklmnopqrstuvwxyz0123456789,"
    cjk = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余０１2二３三四5六七，"
    own = (
        "cjk_documents AS MATERIALIZED (SELECT doc_id, "
        f"translate(replace(text, '.', '\\n'), '{letters}', '{cjk}') AS text FROM documents)"
    )
    body = sql.replace("FROM documents", "FROM cjk_documents").strip()
    return f"WITH {own}, {body[5:]}" if body.startswith("WITH ") else f"WITH {own} {body}"


# The quantile of the normal distribution that leaves a quarter above it.
_Z_PRUNE = 0.6744897501960817


def _expected_sql(pos: str, neg: str) -> str:
    """Upper end of the Wilson interval for the errors of a leaf."""
    n, e, z = f"({pos} + {neg})", f"least({pos}, {neg})", _Z_PRUNE
    root = f"sqrt({e} / {n} / {n} - ({e} / {n}) ** 2 / {n} + {z}::DOUBLE ** 2 / (4 * {n} ** 2))"
    return f"({n} * ({e} / {n} + {z}::DOUBLE ** 2 / (2 * {n}) + {z} * {root}) / (1 + {z}::DOUBLE ** 2 / {n}))"


def _pruned_sql(depth: int) -> list[str]:
    """Nodes of the grown tree from the bottom up; ``cut`` are leaves in the end."""
    parts = [
        f"""kept{depth} AS MATERIALIZED (
            SELECT node, sum(label) * any_value(w) AS pos, (count(*) - sum(label))::DOUBLE AS neg,
                   {_expected_sql('(sum(label) * any_value(w))', '(count(*) - sum(label))::DOUBLE')} AS err,
                   false AS cut
            FROM rows{depth}, wgt GROUP BY node)"""
    ]
    for d in reversed(range(depth)):
        whole = _expected_sql("pos", "neg")
        parts.append(
            f"""kept{d} AS MATERIALIZED (
            SELECT * FROM kept{d + 1} UNION ALL
            SELECT node, pos, neg, least(whole, err) AS err, round(whole, 9) <= round(err, 9) AS cut
            FROM (SELECT *, {whole} AS whole
                  FROM (SELECT b.node, sum(pos) AS pos, sum(neg) AS neg, sum(err) AS err
                        FROM best{d} b JOIN kept{d + 1} k ON k.node // 2 = b.node GROUP BY b.node)))"""
        )
    # A row ends in the first of its nodes, from the root, that is cut, else in its own.
    above = " UNION ALL ".join(f"SELECT word, node AS own, node >> {k} AS node FROM rows{depth}" for k in range(depth + 1))
    return [
        *parts,
        f"""final AS MATERIALIZED (
            SELECT word, coalesce(min(node) FILTER (node IN (SELECT node FROM kept0 WHERE cut)), any_value(own)) AS node
            FROM ({above}) GROUP BY word)""",
        """decided AS MATERIALIZED (
            SELECT word, label::INTEGER AS label,
                   CASE WHEN pos > neg THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction
            FROM final JOIN kept0 USING (node) JOIN table0 USING (word))""",
    ]


_STORED_RULES = """
        SELECT node::BIGINT AS node, name AS feature, value, NULL::DOUBLE AS prediction
        FROM splits JOIN names USING (feature)
        WHERE node NOT IN (SELECT n FROM gone)
        UNION ALL
        SELECT node, NULL, NULL, CASE WHEN pos > neg THEN 1.0 ELSE 0.0 END
        FROM kept0 WHERE node NOT IN (SELECT n FROM gone WHERE NOT self)
          AND (cut OR node NOT IN (SELECT node FROM splits))"""


def _stored_rules_sql(depth: int) -> list[str]:
    cols = "freq freedom cohesion dice mi scp zscore tscore".split()
    names = ", ".join(f"({i}, '{c}')" for i, c in enumerate(cols))
    splits = " UNION ALL ".join(f"SELECT node, feature, value FROM best{d}" for d in range(depth))
    return [
        f"names(feature, name) AS (VALUES {names})",
        f"splits AS MATERIALIZED ({splits})",
        # What is at or below a cut node.
        f"""gone AS MATERIALIZED (
            SELECT k.node AS n, bool_and(k.node = c.node) AS self
            FROM kept0 k JOIN (SELECT node FROM kept0 WHERE cut) c
              ON c.node IN ({', '.join(f'k.node >> {j}' for j in range(depth + 1))})
            GROUP BY k.node)""",
    ]


def _rules_sql(depth: int, needs: str = "feat measures lex", more: tuple = (), body: str | None = None) -> str:
    """The tree, one group of tables per level; a node without a gain stays."""
    cols = "freq freedom cohesion dice mi scp zscore tscore".split()
    h = lambda a, n: f"(CASE WHEN {a} > 0 THEN -({a}) / ({n}) * ln(({a}) / ({n})) ELSE 0 END)"
    entropy = lambda a, b: f"({h(a, f'{a} + {b}')} + {h(b, f'{a} + {b}')})"
    parts = [
        f"""table0 AS MATERIALIZED (
            SELECT word, round(feat.freq, 6)::DOUBLE AS freq, round(freedom, 6) AS freedom,
                   round(cohesion, 6) AS cohesion, round({_DICE}, 6) AS dice,
                   round({_MI}, 6) AS mi, round(ln({_SCP}), 6) AS scp,
                   round({_Z}, 6) AS zscore, round({_T}, 6) AS tscore,
                   (word IN (SELECT word FROM lex))::BIGINT AS label
            FROM (SELECT feat.*, n, s, p, t, ksi FROM feat JOIN measures USING (word)) feat)""",
        """wgt AS MATERIALIZED (
            SELECT CASE WHEN sum(label) > 0 AND sum(label) < count(*)
                        THEN (count(*) - sum(label))::DOUBLE / sum(label)::DOUBLE
                        ELSE 1.0 END AS w FROM table0)""",
        "rows0 AS MATERIALIZED (SELECT *, 1 AS node FROM table0)",
    ]
    for d in range(depth):
        long = " UNION ALL ".join(
            f"SELECT node, label, {i} AS feature, {c} AS value FROM rows{d} WHERE {c} IS NOT NULL"
            for i, c in enumerate(cols)
        )
        order = "(PARTITION BY node, feature ORDER BY value)"
        parts += [
            f"""upto{d} AS MATERIALIZED (
            SELECT node, feature, value, sum(n) OVER {order} AS n, sum(pos) OVER {order} AS pos
            FROM (SELECT node, feature, value, count(*) AS n, sum(label) AS pos
                  FROM ({long}) GROUP BY ALL))""",
            f"""tried{d} AS MATERIALIZED (
            SELECT node, feature, value,
                   round({entropy('ap', 'an')} - (pp + pn) / (ap + an) * {entropy('pp', 'pn')}
                         - (ap + an - pp - pn) / (ap + an)
                           * {entropy('(ap - pp)', '(an - pn)')}, 9) AS gain,
                   {entropy('(pp + pn)', '(ap + an - pp - pn)')} AS info
            FROM (SELECT u.*, u.pos * w AS pp, (u.n - u.pos)::DOUBLE AS pn,
                         g.pos * w AS ap, (g.n - g.pos)::DOUBLE AS an
                  FROM upto{d} u
                  JOIN (SELECT node, count(*) AS n, sum(label) AS pos FROM rows{d}
                        GROUP BY node) g USING (node), wgt
                  WHERE u.n < g.n))""",
            f"""best{d} AS MATERIALIZED (
            SELECT node, feature, value FROM (
                SELECT *, row_number() OVER (
                           PARTITION BY node ORDER BY round(gain / info, 9) DESC, feature) AS k
                FROM (SELECT *, avg(gain) OVER (PARTITION BY node) AS mean
                      FROM (SELECT *, row_number() OVER (
                                PARTITION BY node, feature ORDER BY gain DESC, value) AS j
                            FROM tried{d}) WHERE j = 1)
                WHERE gain > 0 AND gain + 1e-9 >= mean) WHERE k = 1)""",
        ]
        value = "CASE feature " + " ".join(f"WHEN {i} THEN r.{c}" for i, c in enumerate(cols)) + " END"
        parts.append(
            f"""rows{d + 1} AS MATERIALIZED (
            SELECT r.* REPLACE (CASE WHEN b.feature IS NULL THEN r.node
                                     WHEN {value} <= b.value THEN 2 * r.node
                                     ELSE 2 * r.node + 1 END AS node)
            FROM rows{d} r LEFT JOIN best{d} b ON b.node = r.node)"""
        )
    body = body or f"""
        SELECT word, label::INTEGER AS label,
               CASE WHEN sum(label) OVER n * w > count(*) OVER n - sum(label) OVER n
                    THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction
        FROM rows{depth}, wgt WINDOW n AS (PARTITION BY node)"""
    return _with(needs, "") + ", " + ",\n".join([*parts, *more]) + body


def _envelope_job(more: str) -> str:
    return f"""
        SELECT {_FEATURES} FROM feat
        WHERE {_STOPPED} AND {_in_limits(f"(SELECT * FROM feat WHERE {_STOPPED})")} {more}"""
