"""One job for each operator of this package, over its whole tables, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (decontamination, jaccard_join, merkle_manifest, packing, periodic_runs, prefix_bpe, quality_classifier, quality_rules, secret_scan, sharding, substring_dedup,
                         token_files, url_filter)
from tessera.llm.common import read_table

# The rules of the URL job.
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: The block list that the cascade encodes: addresses (host and path) with a page that has a row of three such signs in its html.
JUNK = r"[*%$#]{3}"


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", "doc_id", "text")


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_documents(_texts(spark, sf_dir), read_table(spark, sf_dir, "labels", "doc_id", "quality"))


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_documents(_texts(spark, sf_dir), _tokenizer("word_bpe_49k.json"))


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages", "page_id", "url", "html")
    address = F.concat(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")))
    listed = pages.where(F.col("html").rlike(JUNK)).select(address.alias("url"))
    return url_filter.judge(pages, URL_RULES, listed, "url")


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_texts(spark, sf_dir))


def without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_texts(spark, sf_dir))


def near_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_texts(spark, sf_dir))


def packed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_texts(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))


def rule_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(_texts(spark, sf_dir))


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_texts(spark, sf_dir), read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def _planted(docs: DataFrame) -> DataFrame:
    """Every tenth text, by crc32 of its id, turned periodic from a word on, as the contract of the run job fixes it."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(crc / 10)
    split = docs.select("doc_id", "text", g.alias("g"), F.when(crc % 10 == 0, F.filter(
        F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("w"))
    n = F.size("w")
    at = split.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    at = at.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    left = n - F.col("a")
    again = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    changed = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")
    return at.select("doc_id", F.when(n > 0, changed).otherwise(F.col("text")).alias("text"))


def runs_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = F.col("runs")
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("length"), r["start"], r["period"])))
    lines = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = periodic_runs.collapse_runs(_planted(_texts(spark, sf_dir)))
    rows = found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_words", "n_runs", F.col("best.start").alias("start"), (-F.col("best.length")).alias("length"),
                       F.col("best.period").alias("period"), F.floor(-1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                       "runs_sha256", "collapsed_sha256")


def _lowered_where_tampered(docs: DataFrame) -> Column:
    """The text as the contract of the manifest job tampers with it: A-Z in lower case where 3 divides the id's crc32."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lower).otherwise(F.col("text"))


def manifest_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = docs.select("doc_id", "lang", merkle_manifest.leaf_digest([F.col(c) for c in fields]).alias("leaf"), merkle_manifest.leaf_digest(
        [_lowered_where_tampered(docs) if c == "text" else F.col(c) for c in fields]).alias("altered"))
    manifest = merkle_manifest.build(docs, "lang", "doc_id", "leaf")
    proofs = manifest.prove()
    folded = merkle_manifest.folded(F.col("altered"), F.col("path"))
    return proofs.select("doc_id", "leaf", "subroot", "root", merkle_manifest.siblings_digest(F.col("path")).alias("proof_sha256"),
                         folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def prefix_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prefix_bpe.encode_documents(_texts(spark, sf_dir), _tokenizer("word_bpe_49k.json"), with_text=True)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(_texts(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": quality_scores,
    "op2_token_files": token_ids,
    "op3_url_filter": url_verdicts,
    "op4_sharding": shards,
    "op5_substring_dedup": without_repeats,
    "op6_ngram_jaccard_join": near_duplicate_groups,
    "op7_packing": packed_pieces,
    "op8_quality_rules": rule_verdicts,
    "op9_decontamination": benchmark_leaks,
    "op10_secret_scan": secrets,
    "op11_periodic_runs": runs_collapsed,
    "op12_merkle_manifest": manifest_proofs,
    "op13_prefix_bpe": prefix_ids,
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string in DuckDB: bit by bit, each byte followed by seven zeros."""
    bits = f"list_transform(range(8 * length({text})), lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr({text}, CAST(i // 8 + 1 AS INTEGER), 1)) ELSE 0 END::BIGINT)"
    step = "xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda c, x: {step}), 4294967295)"


def _manifest_sql(levels: int = 7, upper: int = 3) -> str:
    """The manifest job in DuckDB, for up to 8 ** levels leaves of a language and 8 ** upper languages."""
    def framed(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"

    fields = " || ".join(framed(c) for c in ("doc_id", "source", "lang", "n_chars"))
    tampered = f"CASE WHEN {_crc32_sql('doc_id::VARCHAR')} % 3 = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END"
    ctes = [f"""d AS (SELECT doc_id, lang, sha256({fields} || {framed('text')}) AS leaf, sha256({fields} || {framed(f'({tampered})')}) AS altered FROM documents)""",
            """l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS n FROM d)""",
            "a0 AS (SELECT lang AS g, rank AS pos, leaf AS h, n FROM l)"]

    def tree(name: str, height: int) -> None:
        for k in range(height):
            ctes.append(f"{name}{k + 1} AS (SELECT g, pos // 8 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h, (n + 7) // 8 AS n FROM {name}{k} WHERE n > 1 GROUP BY g, pos // 8, n)")
            over = "OVER (PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN"
            ctes.append(f"{name}o{k} AS (SELECT g, pos, coalesce(string_agg(h, '') {over} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre, "
                        f"coalesce(string_agg(h, '') {over} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post FROM {name}{k} WHERE n > 1)")

    tree("a", levels)
    ctes.append("s AS (" + " UNION ALL ".join(f"SELECT g, h AS subroot FROM a{k} WHERE n = 1" for k in range(levels + 1)) + ")")
    ctes.append("b0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, subroot AS h, count(*) OVER () AS n, g AS lang FROM s)")
    tree("b", upper)
    ctes.append("r AS (" + " UNION ALL ".join(f"SELECT h AS root FROM b{k} WHERE n = 1" for k in range(upper + 1)) + ")")
    ctes.append("p0 AS (SELECT l.doc_id, l.lang, l.rank, l.leaf, b0.h AS subroot, b0.pos AS place, '' AS siblings, l.altered AS x FROM l JOIN b0 ON l.lang IS NOT DISTINCT FROM b0.lang)")
    steps = [("a", k, "o.g IS NOT DISTINCT FROM p.lang AND o.pos = p.rank") for k in range(levels)] + [("b", k, "o.pos = p.place") for k in range(upper)]
    for i, (name, k, on) in enumerate(steps):
        on = on.replace("p.rank", f"p.rank // {8 ** k}").replace("p.place", f"p.place // {8 ** k}")
        ctes.append(f"p{i + 1} AS (SELECT p.* EXCLUDE (siblings, x), p.siblings || coalesce(o.pre || o.post, '') AS siblings, "
                    f"CASE WHEN o.pos IS NULL THEN x ELSE sha256(o.pre || x || o.post) END AS x FROM p{i} p LEFT JOIN {name}o{k} o ON {on})")
    return "WITH " + ",\n".join(ctes) + f"""
        SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, x AS folded_root, x = root AS verified FROM p{len(steps)}, r"""


ORACLE: dict[str, str] = {
    "op5_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM w, unnest(generate_series(1, len(ws) - 12)) t(i)),
        first AS (SELECT g, min(doc_id) AS least FROM win GROUP BY g),
        gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM win JOIN first USING (g), range(0, 13) r(k) WHERE least < doc_id),
        word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op6_ngram_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(generate_series(1, greatest(len(ws) - 4, 1))) t(i) WHERE len(ws) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
        SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
    "op12_merkle_manifest": _manifest_sql(),
    "op3_url_filter": r"""
        with parts as (
            select page_id,
                   translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path,
                   coalesce(regexp_matches(html, '[*%$#]{3}'), false) as junk
            from pages),
        listed as (select distinct host || path as address from parts where junk),
        ruled as (
            select *, case
                when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
                when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
                when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
                when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
                when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/'
                end as rule
            from parts)
        select page_id, host, path, rule, case
            when rule in ('example.org/en/1', 'example.org/es/', 'com/de/') then 'block'
            when rule in ('com/fr/', 'org/') then 'allow'
            when host || path in (select address from listed) then 'block'
            else 'allow' end as verdict
        from ruled""",
}
