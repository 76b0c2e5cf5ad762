"""One registered query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlens.llm import (
    audit,
    bpe,
    decontam,
    jaccard,
    langid,
    licenses,
    linededup,
    lzprint,
    pages,
    pii,
    repeats,
    toxicity,
    wht,
)
from meshlens.llm.common import bucket, send_package

Query = Callable[[SparkSession, str], DataFrame]
#: The registered query's secret; a real run takes its own from a safe place.
KEY = "registered query"
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return send_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> tuple[str, str]:
    """Rank file and pre-token pattern; any rank file of this kind may take their place."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query("op1_byte_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, path, pattern, keep=["doc_id"])
    both = bpe.decode(coded, path, pattern)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op6_benchmark_leaks",
    rf"""
    WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    sized AS (SELECT item_id, w, least(len(w), 10) AS size FROM item WHERE len(w) > 0),
    win AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS gram
      FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM sized)),
    doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    place AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram
      FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
            FROM doc, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)),
    hit AS (SELECT doc_id, i, size, item_id FROM place JOIN win USING (size, gram)),
    words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
      FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM hit) GROUP BY 1),
    found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY 1)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
      CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AS contaminated
    FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = decontam.hit_words()
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("leak_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leak_items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_PHRASES = ", ".join(f"('{p}', '{label}')" for p, label in licenses.PHRASES.items())
_NOTICES = ", ".join(f"('{label}', '(^| ){licenses.as_regex(t)}')" for label, t in licenses.TEMPLATES)


@query(
    "op8_licenses",
    rf"""
    WITH phrase(phrase, label) AS (VALUES {_PHRASES}), notice(label, rx) AS (VALUES {_NOTICES}),
    doc AS (SELECT doc_id, w, array_to_string(w, ' ') || ' ' AS joined
      FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
    place AS (SELECT doc_id, label, i FROM (SELECT doc_id, label, phrase, w,
        len(string_split(phrase, ' ')) AS n, unnest(range(1, len(w) + 1)) AS i
        FROM doc, phrase WHERE contains(joined, phrase))
      WHERE array_to_string(w[i:i + n - 1], ' ') = phrase),
    base AS (SELECT doc_id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word
      FROM place GROUP BY 1),
    found AS (SELECT doc_id, label, false AS own FROM place
      UNION SELECT doc_id, label, true FROM doc, notice WHERE regexp_matches(joined, rx)),
    named AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (NOT own) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) AS labels, bool_or(own) AS own
      FROM found GROUP BY 1)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
      CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
      coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
      CASE WHEN own THEN 1e0 WHEN labels IS NOT NULL THEN 5e-1 ELSE 0e0 END AS score
    FROM doc LEFT JOIN base USING (doc_id) LEFT JOIN named USING (doc_id)""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan(docs, keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min("base_places").alias("first_word"),
        F.array_max("base_places").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", "notices")), ",").alias("labels"),
        F.when(F.size("notices") > 0, 1.0).when(F.size("base_labels") > 0, 0.5).otherwise(0.0).alias("score"),
    )


@query("op5_language")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(bucket("doc_id", 3) != 1).select("text", "lang"))
    held_out = F.coalesce(bucket("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return langid.predict(docs.select("doc_id", held_out, "text"), model, keep=["doc_id", "held_out"])


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(bucket("doc_id", 5) != 0).select("doc_id", "toxic"))
    held_out = F.coalesce(bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return toxicity.score(docs.select("doc_id", held_out, "text"), model, keep=["doc_id", "held_out"])


@query("op4_lz_fingerprint")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lzprint.fingerprints(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


@query("op7_main_text")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pages.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return made.withColumn("n_chars", F.length("text").cast("long"))


_PLAIN = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"


@query(
    "op10_jaccard_join",
    rf"""
    WITH RECURSIVE doc AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
    gram AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
    size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY 1),
    pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
      FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
      WHERE 100 * pair.n >= 80 * (x.n + y.n - pair.n)),
    reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
    top AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY 1)
    SELECT doc.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles,
      least(doc.doc_id, coalesce(top.b, doc.doc_id)) AS component_id
    FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN top USING (doc_id)""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


@query("op3_surrogates")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = pii.pseudonymise(docs, KEY, found="kinds")
    return made.select(
        "doc_id",
        "text",
        F.size("kinds").cast("long").alias("n_entities"),
        F.array_join("kinds", ",").alias("kinds"),
    )


@query("op2_repeated_passages")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated(table(spark, sf_dir, "documents"))


def _rounds(n: int) -> str:
    """Assignments a0 .. an and the centroids between them."""
    out = []
    for k in range(n + 1):
        out.append(f"""
    a{k} AS (SELECT r, c, d FROM (SELECT r, c, d, row_number() OVER (PARTITION BY r ORDER BY d, c) AS nth
      FROM (SELECT x.r, y.c, sum((x.v - y.v) * (x.v - y.v)) AS d FROM long x JOIN c{k} y USING (i) GROUP BY 1, 2)) WHERE nth = 1)""")
        if k < n:
            out.append(f"""
    c{k + 1} AS (SELECT c, i, CASE WHEN n IS NULL THEN v ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS v
      FROM c{k} LEFT JOIN (SELECT c, i, sum(v) AS s, count(*) AS n FROM a{k} JOIN long USING (r) GROUP BY 1, 2) USING (c, i))""")
    return ",".join(out)


@query(
    "op11_centroid_clusters",
    f"""
    WITH kept AS (SELECT row_number() OVER () AS r, vec_id,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
    long AS (SELECT r, i, v[i] AS v FROM (SELECT r, v, unnest(range(1, 65)) AS i FROM kept)),
    top AS (SELECT v, row_number() OVER (ORDER BY h, v) - 1 AS c FROM (
      SELECT v, sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM kept ORDER BY h, v LIMIT 40)),
    c0 AS (SELECT c, i, v[i] AS v FROM (SELECT c, v, unnest(range(1, 65)) AS i FROM top)),{_rounds(5)},
    named AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS h FROM c5 GROUP BY 1)
    SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
      CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
      h AS centroid_sha256
    FROM a5 JOIN kept USING (r) JOIN named USING (c)""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wht.cluster(table(spark, sf_dir, "embeddings"))


_BLANK_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_TESTS = {
    "A": "len(w) < 50",
    "B": "100 * len(list_distinct(w)) < 65 * len(w)",
    "C": "100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t)",
    "D": "regexp_matches(t, '[#$%&*|]')",
    "E": "coalesce(doc_id > first_id, false)",
}
_STEPS = ", ".join(f"('{o}', {k}, '{f}', '{b}')" for o, k, f, b in audit.prefixes(list(_TESTS)))


@query(
    "op12_filter_audit",
    rf"""
    WITH step(filter_order, step, filter, before) AS (VALUES {_STEPS}),
    label AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
    doc AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_BLANK_WORDS} AS w,
        min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
    cell AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n,
        {" || ".join(f"CASE WHEN {test} THEN '{f}' ELSE '' END" for f, test in _TESTS.items())} AS fails
      FROM doc LEFT JOIN label USING (doc_id) GROUP BY ALL),
    met AS (SELECT *, contains(fails, filter) AS hit, len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0
        AND before <> '' AND fails <> '' AS gone FROM cell, step),
    found AS (SELECT part, filter_order, step, filter, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN fails = filter THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN NOT gone AND hit AND good THEN n ELSE 0 END) AS good_lost,
        sum(CASE WHEN NOT gone AND hit AND toxic THEN n ELSE 0 END) AS toxic_lost
      FROM met GROUP BY 1, 2, 3, 4)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, {", ".join(f"CAST({m} AS BIGINT) AS {m}" for m in audit.MEASURES)},
      CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
    FROM found""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op13_line_dedup",
    f"""
    WITH doc AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    line AS (SELECT r, doc_id, i, line, {_KEY} AS k
      FROM (SELECT r, doc_id, i, lines[i] AS line FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM doc))),
    shared AS (SELECT k, min(doc_id) AS first_id FROM line WHERE length(k) >= 10 GROUP BY 1
      HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 2),
    marked AS (SELECT r, i, line, first_id IS NOT NULL AND doc_id IS DISTINCT FROM first_id AS gone FROM line LEFT JOIN shared USING (k))
    SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
    FROM doc JOIN (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
      string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS kept FROM marked GROUP BY 1) USING (r)""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = linededup.dedupe_lines(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
