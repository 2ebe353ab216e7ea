"""SQL over the given tables that gives the rows of queries that SQL can express."""

from __future__ import annotations

from embertrace.llm.odd_sketch import Plan
from embertrace.llm.quality import Rules
from embertrace.llm.quantised_tiles import Tiles

_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
                                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM words
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * both_n >= {Plan().percent} * (x.n + y.n - both_n)
), edges AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT doc_id AS id, doc_id AS other FROM documents
    UNION
    SELECT r.id, e.b FROM reach r JOIN edges e ON r.other = e.a
), labels AS (
    SELECT id, min(other) AS component_id FROM reach GROUP BY id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN labels ON id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""


def _quality(rules: Rules) -> str:
    classes = [r"[a-z]+", r"[\x20\x09-\x0D]+", r"[A-Z]+", r"[0-9]+", r"[#*$%&|<>]+", r"[.,;:!?''\"()-]+", r"\p{L}+"]
    steps, last = [], "documents"
    for k, pattern in enumerate(classes):
        text = "coalesce(text, '')" if k == 0 else "rest"
        keep = "doc_id, lang, coalesce(text, '') AS text" if k == 0 else f"* EXCLUDE (rest)"
        steps.append(
            f"t{k} AS (SELECT {keep}, length({text}) - length(regexp_replace({text}, '{pattern}', '', 'g')) AS c{k}, "
            f"regexp_replace({text}, '{pattern}', '', 'g') AS rest FROM {last})"
        )
        last = f"t{k}"
    names = [f"c{k}" for k in range(8)]
    chars = " + ".join(names)
    term = "CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0.0 END"
    parts = " + ".join(
        f"{term.format(a=p, b=q)} + {term.format(a=q, b=p)}"
        for p, q in ((f"(d.c{k} / greatest(d.chars, 1))", f"r.s{k}") for k in range(8))
    )
    return f"""
WITH {", ".join(steps)}, counted AS (
    SELECT * EXCLUDE (rest), length(rest) AS c7, {_WORDS.format("text")} AS w FROM t6
), docs AS (
    SELECT *, {chars} AS chars, len(w) AS n_words FROM counted
), windows AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS times
    FROM (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, n_words - 1)) AS i FROM docs))
), repeats AS (
    SELECT doc_id, count(DISTINCT place) AS n FROM (
        SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM windows WHERE times > 1) GROUP BY doc_id
), lines AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), langs AS (
    SELECT lang, count(*) AS docs, sum(n_words) AS words, sum(chars) AS chars, {", ".join(f"sum(c{k}) / sum(chars) AS s{k}" for k in range(8))}
    FROM docs WHERE lang IS NOT NULL GROUP BY lang ORDER BY docs DESC, lang LIMIT {rules.languages}
), tallies AS (
    SELECT doc_id, lang, word, count(*) AS n FROM (SELECT doc_id, lang, unnest(list_transform(w, lambda x: lower(x))) AS word FROM docs)
    GROUP BY ALL
), common AS (
    SELECT lang, word, sum(n) / any_value(words) AS share FROM tallies JOIN langs USING (lang) GROUP BY lang, word
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, word) <= {rules.common_words}
), judged AS (
    SELECT d.*, r.lang AS ref, {parts} AS class_sum
    FROM docs d JOIN langs r ON r.lang = d.lang OR d.lang IS NULL OR d.lang NOT IN (SELECT lang FROM langs)
    WHERE d.n_words >= {rules.min_words} AND d.chars >= {rules.min_chars}
), bins AS (
    SELECT j.doc_id, j.ref, c.share AS q, coalesce(t.n, 0) / j.n_words AS p
    FROM judged j JOIN common c ON c.lang = j.ref LEFT JOIN tallies t ON t.doc_id = j.doc_id AND t.word = c.word
), rest AS (
    SELECT doc_id, ref, 1 - sum(p) AS p, greatest(0.0, 1 - sum(q)) AS q FROM bins GROUP BY doc_id, ref
), words AS (
    SELECT doc_id, ref, sum({term.format(a="p", b="q")} + {term.format(a="q", b="p")}) AS word_sum
    FROM (SELECT doc_id, ref, p, q FROM bins UNION ALL SELECT doc_id, ref, p, q FROM rest) GROUP BY doc_id, ref
), nearest AS (
    SELECT doc_id, min({{'w': sqrt(greatest(0.0, word_sum / 2)), 'c': sqrt(greatest(0.0, class_sum / 2))}}) AS d
    FROM judged JOIN words USING (doc_id, ref) GROUP BY doc_id
)
SELECT d.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(chars - c1 AS BIGINT) AS word_chars, CAST(c4 AS BIGINT) AS n_symbols,
       coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
       n_words < 50 OR 100 * coalesce(r.n, 0) > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * coalesce(r.n, 0) > 50 * n_words)
       AND NOT coalesce(x.d.w > {rules.word_distance} OR x.d.c > {rules.class_distance}, false) AS kept
FROM docs d LEFT JOIN lines l USING (doc_id) LEFT JOIN repeats r USING (doc_id) LEFT JOIN nearest x USING (doc_id)
"""


QUALITY = _quality(Rules())


_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SOURCE_DIVERGENCE = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER.format("text")} AS text FROM documents
), terms AS (
    SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
    SELECT lang, term, count(*) AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL
), sources AS (
    SELECT DISTINCT lang, source FROM docs
), langs AS (
    SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), shares AS (
    SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
           1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (sum(coalesce(c.n, 0)) OVER (PARTITION BY s.lang, s.source) + 2 * l.v) AS p,
           1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v) AS q
    FROM sources s JOIN kept k ON k.lang = s.lang JOIN langs l ON l.lang = s.lang
    LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), apart AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
    FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 10
"""

NEAR_VECTORS = f"""
WITH RECURSIVE fit AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), unit AS (
    SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS norm FROM fit
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_inner_product(a.v, b.v) / (a.norm * b.norm) >= {Tiles().cosine}
), reach AS (
    SELECT vec_id AS id, vec_id AS other FROM embeddings
    UNION
    SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a
), labels AS (
    SELECT id, min(other) AS component_id FROM reach GROUP BY id
), degrees AS (
    SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN labels ON id = e.vec_id LEFT JOIN degrees ON a = e.vec_id
"""

_TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL_SEARCH = f"""
WITH words AS (
    SELECT doc_id, unnest({_TERMS.format(_LOWER.format("text"))}) AS term FROM documents
), lengths AS (
    SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
), corpus AS (
    SELECT count(*) AS docs, sum(n) AS terms FROM lengths
), asked AS (
    SELECT DISTINCT item_id, unnest({_TERMS.format(_LOWER.format("text"))}) AS term FROM benchmark
), found AS (
    SELECT doc_id, term, count(*) AS tf FROM words SEMI JOIN asked USING (term) GROUP BY ALL
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM found, corpus GROUP BY term, docs
), scores AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
    FROM asked JOIN found USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), corpus GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""
