"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from ledgerleaf.llm import embedding_dedup, mixing
from ledgerleaf.llm import quality_rules as rules

_RATIO = (1 + rules.ACCURACY) / (1 - rules.ACCURACY)
_ZERO = -(1 << 20)


def _quality(docs: str) -> str:
    """CTEs that end in ``verdicts``: the columns of ``docs`` with counts and verdict."""
    cutoffs = "\n".join(
        f", cut_{level} AS (SELECT {keys} measure, any_value(total) AS total,"
        f" min(value) FILTER (cum >= 0.5 * total) + {rules.SPREAD!r} * (min(value) FILTER (cum >= 0.75 * total)"
        f" - min(value) FILTER (cum >= 0.25 * total)) AS fence"
        f" FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} measure) AS total,"
        f" sum(n) OVER (PARTITION BY {keys} measure ORDER BY bucket) AS cum,"
        f" CASE WHEN bucket = {_ZERO} THEN 0.0 ELSE {2 / (_RATIO + 1)!r} * pow({_RATIO!r}, bucket) END AS value"
        f" FROM (SELECT {keys} measure, bucket, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY ALL)"
        for level, keys in (("source", "lang, source,"), ("lang", "lang,"), ("all", ""))
    )
    slack = " ".join(f"WHEN '{m}' THEN {v!r}" for m, v in rules.SLACK.items())
    return rf"""
    texts AS (
      SELECT *, coalesce(text, '') AS t_, row_number() OVER () AS row_,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws_,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls_
      FROM {docs}),
    grams AS (
      SELECT row_, i, ws_[i] || ' ' || ws_[i + 1] || ' ' || ws_[i + 2] AS gram
      FROM (SELECT row_, ws_, unnest(range(1, len(ws_) - 1)) AS i FROM texts)),
    again AS (SELECT row_, i FROM (SELECT *, count(*) OVER (PARTITION BY row_, gram) AS c FROM grams) WHERE c > 1),
    repeated AS (
      SELECT row_, count(DISTINCT i + step) AS n FROM again, (VALUES (0), (1), (2)) AS s(step) GROUP BY row_),
    counted AS (
      SELECT texts.*, len(ws_)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(ws_, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(t_, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(ls_) - len(list_distinct(ls_)))::BIGINT AS n_dup_lines,
        coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, len(ls_)::BIGINT AS n_lines
      FROM texts LEFT JOIN repeated USING (row_)),
    measured AS (
      SELECT row_, lang, source, unnest(['symbols', 'dup_lines', 'repeats']) AS measure,
        unnest([n_symbols / nullif(n_words, 0), n_dup_lines / nullif(n_lines, 0), n_repeat_words / nullif(n_words, 0)]) AS value
      FROM counted),
    sketch AS (
      SELECT lang, source, measure,
        CASE WHEN value > 0 THEN ceil(ln(value) / ln({_RATIO!r}))::BIGINT ELSE {_ZERO} END AS bucket, count(*) AS n
      FROM measured WHERE value IS NOT NULL GROUP BY ALL)
    {cutoffs},
    limits AS (
      SELECT s.lang, s.source, s.measure, greatest(CASE
        WHEN s.total >= {rules.LEAST_DOCUMENTS} THEN s.fence
        WHEN l.total >= {rules.LEAST_DOCUMENTS} THEN l.fence ELSE a.fence END,
        CASE s.measure {slack} END) AS cutoff
      FROM cut_source AS s JOIN cut_lang AS l ON s.lang IS NOT DISTINCT FROM l.lang AND s.measure = l.measure
        JOIN cut_all AS a ON s.measure = a.measure),
    judged AS (
      SELECT m.row_, bool_or(m.value > limits.cutoff) AS outlying
      FROM measured AS m JOIN limits ON m.lang IS NOT DISTINCT FROM limits.lang
        AND m.source IS NOT DISTINCT FROM limits.source AND m.measure = limits.measure
      GROUP BY m.row_),
    verdicts AS (
      SELECT counted.*, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed,
        NOT base_failed AND NOT coalesce(outlying, false) AS kept
      FROM counted LEFT JOIN judged USING (row_))"""


QUALITY_RULES = (
    f"WITH {_quality('documents')} SELECT doc_id, {', '.join(rules.COUNTS)}, base_failed, kept FROM verdicts"
)


def _mixing(docs: str) -> str:
    """CTEs that end in ``taken``: the columns of ``docs`` with what the mix takes of each."""
    weights = ", ".join(map(str, mixing.WEIGHTS))
    copies = " + ".join(
        f"greatest(0, least(size, floor(target + 0.5)::BIGINT - start - {e} * source_size))" for e in range(mixing.EPOCHS)
    )
    return rf"""
    sized AS (
      SELECT *, len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}'))::BIGINT AS size,
        md5(concat_ws('|', doc_id::VARCHAR, md5(coalesce(text, '')))) AS mark
      FROM {docs}),
    ranked AS (
      SELECT source, source_size, source_no, [{weights}][source_no % {len(mixing.WEIGHTS)} + 1] AS weight
      FROM (SELECT source, sum(size)::BIGINT AS source_size,
          row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no FROM sized GROUP BY source)),
    levels AS (
      SELECT *, row_number() OVER o AS place,
        (sum(source_size) OVER () - coalesce(sum({mixing.EPOCHS} * source_size)
          OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM ranked WINDOW o AS (ORDER BY {mixing.EPOCHS} * source_size / weight, source_no)),
    open_ AS (SELECT min(place) AS place, min_by(level, place) AS level FROM levels
      WHERE level * weight <= {mixing.EPOCHS} * source_size),
    targets AS (
      SELECT source, source_size,
        CASE WHEN l.place < o.place THEN ({mixing.EPOCHS} * source_size)::DOUBLE ELSE o.level * weight END AS target
      FROM levels AS l, open_ AS o),
    started AS (
      SELECT sized.*, source_size, target, (sum(size) OVER (
        PARTITION BY sized.source ORDER BY mark, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
      FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
    taken AS (
      SELECT *, ({copies})::BIGINT AS taken, (start + size) / nullif(target, 0) AS finish FROM started)"""


MIXING = f"WITH {_mixing('documents')} SELECT doc_id, size, source_size, target, taken, finish FROM taken"

# All pairs of equal labels, and a component's smallest id by repeated steps along links.
EMBEDDING_DEDUP = f"""
    WITH RECURSIVE usable AS (
      SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM usable AS a JOIN usable AS b
        ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.v, b.v) >= {embedding_dedup.COSINE}),
    reach(vec_id, other) AS (
      SELECT vec_id, vec_id FROM embeddings
      UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.other = links.a)
    SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links,
      c.component_id, e.vec_id = c.component_id AS kept
    FROM embeddings AS e JOIN (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id) AS c USING (vec_id)"""


# A checksum of text of one-byte characters: 0xEDB88320 is the polynomial of crc32.
def _crc32(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    steps = f"flatten(list_transform({codes}, lambda c: [c, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = (
        "CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    )
    return f"xor(list_reduce({steps}, lambda a, x: {step}, 4294967295::BIGINT), 4294967295)"


def _leaf(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    parts = [
        f"coalesce(octet_length(encode({name}::VARCHAR)) || ':' || {name}::VARCHAR, '-')" for name in fields
    ]
    return f"sha256({' || '.join(parts)})"


MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_leaf('n_chars')} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_crc32('doc_id::VARCHAR')} % 7 = 0
      THEN {_leaf('(n_chars::HUGEINT + 1)')} ELSE {_leaf('n_chars')} END AS start
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS row FROM leaves),
trees AS (
  SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER () AS n
  FROM (SELECT DISTINCT lang FROM documents)),
low AS (
  SELECT tree, 0 AS level, pos, placed.n, leaf AS hash
  FROM placed JOIN trees ON placed.lang IS NOT DISTINCT FROM trees.lang
  UNION ALL
  SELECT tree, level + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(hash, '' ORDER BY pos))
  FROM low WHERE n > 1 GROUP BY tree, level, pos // 2),
high AS (
  SELECT 0 AS level, tree AS pos, (SELECT count(*) FROM trees) AS n, hash FROM low WHERE low.n = 1
  UNION ALL
  SELECT level + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(hash, '' ORDER BY pos))
  FROM high WHERE n > 1 GROUP BY level, pos // 2),
climb AS (
  SELECT row, tree, 0 AS level, pos, placed.n, start AS folded, '' AS proof
  FROM placed JOIN trees ON placed.lang IS NOT DISTINCT FROM trees.lang
  UNION ALL
  SELECT c.row, c.tree, c.level + 1, c.pos // 2, (c.n + 1) // 2,
    sha256(CASE WHEN c.pos % 2 = 0 THEN folded || coalesce(s.hash, '') ELSE s.hash || folded END),
    proof || coalesce(s.hash, '')
  FROM climb AS c LEFT JOIN low AS s ON s.tree = c.tree AND s.level = c.level AND s.pos = xor(c.pos, 1)
  WHERE c.n > 1),
ascent AS (
  SELECT row, 0 AS level, tree AS pos, (SELECT count(*) FROM trees) AS n, folded, proof FROM climb WHERE climb.n = 1
  UNION ALL
  SELECT c.row, c.level + 1, c.pos // 2, (c.n + 1) // 2,
    sha256(CASE WHEN c.pos % 2 = 0 THEN folded || coalesce(s.hash, '') ELSE s.hash || folded END),
    proof || coalesce(s.hash, '')
  FROM ascent AS c LEFT JOIN high AS s ON s.level = c.level AND s.pos = xor(c.pos, 1)
  WHERE c.n > 1)
SELECT doc_id, leaf, sub.hash AS subroot, top.hash AS root, sha256(proof) AS proof_sha256,
  folded AS folded_root, folded = top.hash AS verified
FROM placed JOIN trees ON placed.lang IS NOT DISTINCT FROM trees.lang
  JOIN low AS sub ON sub.tree = trees.tree AND sub.n = 1
  JOIN high AS top ON top.n = 1 JOIN ascent ON ascent.row = placed.row AND ascent.n = 1
"""

EXACT_DEDUP = r"""
WITH texts AS (
  SELECT doc_id, coalesce(length(text), 0) AS points,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS squeezed, row_number() OVER () AS row
  FROM documents),
ranked AS (
  SELECT *, row_number() OVER best AS place, count(*) OVER (PARTITION BY squeezed) AS group_size,
    first_value(doc_id) OVER best AS keep_id
  FROM texts
  WINDOW best AS (PARTITION BY squeezed ORDER BY points DESC, doc_id NULLS LAST, row))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(squeezed) AS text_sha256 FROM ranked
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = (
    f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    f"'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')"
)
RANKED_SEARCH = f"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS place, {_TERMS} AS terms FROM documents),
whole AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM texts WHERE len(terms) > 0),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
counts AS (
  SELECT place, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
  FROM (SELECT place, doc_id, len(terms) AS n, unnest(terms) AS term FROM texts)
  WHERE term IN (SELECT term FROM asked) GROUP BY place, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM counts, whole GROUP BY term, n_docs),
scores AS (
  SELECT item_id, place, any_value(doc_id) AS doc_id, sum(
    w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term), whole GROUP BY item_id, place)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (
    PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, place)::INTEGER AS rank FROM scores WHERE score > 0)
WHERE rank <= 50
"""
