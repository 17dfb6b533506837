"""Cleaning, personal data, parsing, profiles and splits over the given texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import parse, pii, text as tx
from tidemark.functions.numbers import rounded, sql_rounded as r
from tidemark.operators import clean, profile, scoring
from tidemark.plans.frames import DOCS, docs, table, texts
from tidemark.shared import small_batches

QUERIES, ORACLES = {}, {}
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def sql_squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def sql_tidied(x: str) -> str:
    for ch in ("!", r"\?", r"\."):
        x = f"regexp_replace({x}, '{ch}{{4,}}', '{ch[-1] * 3}', 'g')"
    return sql_squeezed(f"regexp_replace({x}, '([!?]{{3}})[!?]+', '\\1', 'g')")


@query("clean_tidy", f"SELECT doc_id, {sql_tidied('text')} AS tidy FROM documents")
def clean_tidy(spark, sf):
    return texts(spark, sf, "doc_id", "text").select("doc_id", tx.tidied(F.col("text")).alias("tidy"))


_RAW = "CASE WHEN doc_id % 97 = 0 THEN NULL WHEN doc_id % 89 = 0 THEN '   ' WHEN doc_id % 83 = 0 THEN '!!!' ELSE text END"


@query(
    "clean_reject_reasons",
    f"""WITH d AS (SELECT {_RAW} AS raw FROM documents), e AS (SELECT raw, {sql_tidied("raw")} AS t FROM d)
    SELECT CASE WHEN raw IS NULL THEN 'null_text' WHEN {sql_squeezed("raw")} = '' THEN 'empty_text' WHEN NOT regexp_matches(t, '[\\pL\\pN_]') THEN 'no_content_after_cleaning' ELSE 'kept' END AS reason, count(*) AS n FROM e GROUP BY 1""",
)
def clean_reject_reasons(spark, sf):
    d = table(spark, sf, "documents").select(F.expr(_RAW).alias("raw"))
    return d.select(F.coalesce(tx.reject_reason(F.col("raw"), tx.tidied(F.col("raw"))), F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


_KEY_OF_RAW = "lower(regexp_replace(raw, '^\\s+|\\s+$', '', 'g'))"
_KEY = "lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))"


@query("ingest_dedupe", f"WITH {DOCS} SELECT review_id, row_number() OVER (PARTITION BY {_KEY}, created_at, platform ORDER BY _pos) > 1 AS is_duplicate FROM docs")
def ingest_dedupe(spark, sf):
    return clean.deduped(docs(spark, sf)).select("review_id", "is_duplicate")


@query("identical_kept", "SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS identical_text_rows_kept FROM (SELECT count(*) AS n FROM documents GROUP BY lower(text)) WHERE n > 1")
def identical_kept(spark, sf):
    rows = docs(spark, sf).withColumns({"text_redacted": F.col("text"), "kept": F.lit(True)})
    return clean.identical_kept(rows)


@query(
    "clean_conservation",
    f"""WITH {DOCS}, d AS (SELECT *, CASE WHEN _pos % 97 = 0 THEN NULL WHEN _pos % 89 = 0 THEN '   ' WHEN _pos % 83 = 0 THEN '!!!' ELSE text END AS raw FROM docs),
    e AS (SELECT raw, {sql_tidied("raw")} AS t, raw IS NOT NULL AND {sql_squeezed("raw")} <> '' AND row_number() OVER (PARTITION BY {_KEY_OF_RAW}, created_at, platform ORDER BY _pos) > 1 AS dup FROM d),
    w AS (SELECT CASE WHEN dup THEN 'dup' WHEN raw IS NULL THEN 'null_text' WHEN {sql_squeezed("raw")} = '' THEN 'empty_text' WHEN NOT regexp_matches(t, '[\\pL\\pN_]') THEN 'no_content' ELSE 'kept' END AS fate FROM e)
    SELECT count(*) AS input_rows, count(*) FILTER (WHERE fate = 'kept') AS kept_rows, count(*) FILTER (WHERE fate = 'dup') AS ingestion_duplicates_removed, count(*) FILTER (WHERE fate = 'null_text') AS null_text,
    count(*) FILTER (WHERE fate = 'empty_text') AS empty_text, count(*) FILTER (WHERE fate = 'no_content') AS no_content_after_cleaning, true AS conserved FROM w""",
)
def clean_conservation(spark, sf):
    return _report(spark, sf).select("input_rows", "kept_rows", "ingestion_duplicates_removed", "null_text", "empty_text", "no_content_after_cleaning", "conserved")


def _report(spark, sf):
    raw = F.expr(_RAW.replace("doc_id", "_pos"))
    return clean.report(clean.cleaned(docs(spark, sf).withColumn("text", raw)))


@query("clean_repairs")
def clean_repairs(spark, sf):
    """What cleaning repaired and redacted, of the same rows."""
    return _report(spark, sf).select("rows_with_pii", "pii_redactions_total", "mojibake_repaired", "html_entities_decoded")


@query("clean_batch")
def clean_batch(spark, sf):
    return clean.kept_rows(clean.cleaned(docs(spark, sf)))


@query("pii_redact")
def pii_redact(spark, sf):
    d = texts(spark, sf, "doc_id", "text").withColumn("p", pii.redacted("text"))
    return d.select("doc_id", F.col("p.text").alias("text"), F.aggregate(F.map_values("p.counts"), F.lit(0), lambda a, x: a + x).alias("n"))


@query("pii_counts_by_type")
def pii_counts_by_type(spark, sf):
    return pii.counts_by_type(texts(spark, sf, "text").select(pii.redacted("text").alias("p")).select("p.counts"))


@query("pii_idempotent", "SELECT count(*) AS n, 0::BIGINT AS changed FROM documents")
def pii_idempotent(spark, sf):
    """Redacted texts that a second redaction would change, and leaks found in them."""
    d = texts(spark, sf, "doc_id", "text").select("doc_id", pii.redacted("text")["text"].alias("once"))
    d = d.withColumn("twice", pii.safe_text("once"))
    return d.agg(F.count("*").alias("n"), F.count_if(F.col("once") != F.col("twice")).alias("changed"))


_LEAK_SQL = r"""list_filter([CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}') THEN 'email' END,
  CASE WHEN regexp_matches(text, '(?i)https?://|\bwww\.[a-z0-9]') THEN 'url' END, CASE WHEN regexp_matches(text, '(?i)\b(?:ORD|ACC|CUST)-?\d{4,}') THEN 'prefixed_id' END], lambda x: x IS NOT NULL)"""


@query("leak_scan", f"SELECT doc_id, array_to_string({_LEAK_SQL}, ',') AS hits FROM documents")
def leak_scan(spark, sf):
    """The patterns that need no look-around, so that SQL can say the same."""
    hits = F.filter(pii.leak_hits(F.col("text")), lambda h: h.isin("email", "url", "prefixed_id"))
    return texts(spark, sf, "doc_id", "text").select("doc_id", F.array_join(hits, ",").alias("hits"))


_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_PARTS = "string_split(x, '.')"
_BENIGN = f"""(len(list_distinct(string_split({_DIGITS}, ''))) = 1 OR regexp_matches({_DIGITS}, '^[1-9][0-9]{{0,2}}0{{4,}}$') OR regexp_matches(x, '^(19|20)[0-9]{{2}}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$')
  OR regexp_matches({_DIGITS}, '^(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])(19|20)[0-9]{{2}}$')
  OR (len({_PARTS}) = 4 AND len(list_filter({_PARTS}, lambda q: NOT regexp_matches(q, '^[0-9]+$'))) = 0 AND len(list_filter({_PARTS}, lambda q: regexp_matches(q, '^0*(?:[1-9][0-9]{{3,}}|[3-9][0-9][0-9]|2[6-9][0-9]|25[6-9])$'))) > 0))"""
_ALL_LEAKS = r"""list_filter([CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}') THEN 'email' END,
  CASE WHEN regexp_matches(text, '(?i)https?://|\bwww\.[a-z0-9]') THEN 'url' END, CASE WHEN len(list_filter(regexp_extract_all(text, '[0-9](?:[ ()+.-]?[0-9]){6,}'), lambda x: NOT @)) > 0 THEN 'long_digit_run' END,
  CASE WHEN regexp_matches(text, '(?i)\b(?:ORD|ACC|CUST)-?\d{4,}') THEN 'prefixed_id' END, CASE WHEN regexp_matches(text, '(?:^|[^\pL\pM\pN\p{Pc}\[])@[A-Za-z0-9_]{2,}') THEN 'handle' END], lambda x: x IS NOT NULL)""".replace("@))", _BENIGN + "))").replace("NOT @)", "NOT " + _BENIGN + ")")


@query("leak_scan_full", f"SELECT doc_id, array_to_string({_ALL_LEAKS}, ',') AS hits FROM documents")
def leak_scan_full(spark, sf):
    return texts(spark, sf, "doc_id", "text").select("doc_id", F.array_join(pii.leak_hits(F.col("text")), ",").alias("hits"))


@query("leak_tally", f"SELECT pattern, count(*) AS n FROM (SELECT unnest({_ALL_LEAKS}) AS pattern FROM documents) GROUP BY 1")
def leak_tally(spark, sf):
    return pii.leak_tally(texts(spark, sf, "text"), "text")


@query("text_repair")
def text_repair(spark, sf):
    small_batches(spark)
    return table(spark, sf, "pages").select("page_id", tx.repaired(F.col("html")).alias("repaired"), tx.is_mojibake("html").alias("mojibake"))


@query("mojibake_undone", "SELECT doc_id, doc_id % 4 AS times, sha256(coalesce(text, '')) AS text_sha256 FROM documents")
def mojibake_undone(spark, sf):
    """Every text is read in the wrong code page up to three times over, and repaired."""
    wrong = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    times, once = F.col("doc_id") % 4, wrong(F.coalesce("text", F.lit("")))
    damaged = F.when(times == 0, F.coalesce("text", F.lit(""))).when(times == 1, once).when(times == 2, wrong(once)).otherwise(wrong(wrong(once)))
    return texts(spark, sf, "doc_id", "text").select("doc_id", times.alias("times"), F.sha2(tx.demojibaked(damaged), 256).alias("text_sha256"))


@query("text_variants")
def text_variants(spark, sf):
    """Preprocessing variants of each text, by name; raw ones are for reference only."""
    return clean.variants(texts(spark, sf, "doc_id", "text"), "doc_id", "text")


# the words of the list, whole; and those that end in n't
_NOT = ", ".join(f"'{w}'" for w in "not no never none nobody nothing neither nor cannot without dont cant wont didnt isnt doesnt wasnt werent havent hasnt hadnt shouldnt wouldnt couldnt aint arent".split())


@query("negation_counts", f"SELECT doc_id, CAST(len(list_filter(regexp_extract_all(lower(text), '[\\pL\\pM\\pN\\p{{Pc}}]+'), lambda x: x IN ({_NOT}))) + len(regexp_extract_all(lower(text), '[\\pL\\pM\\pN\\p{{Pc}}]+n''t')) AS INTEGER) AS n FROM documents")
def negation_counts(spark, sf):
    return texts(spark, sf, "doc_id", "text").select("doc_id", tx.negations(F.col("text")).alias("n"))


@query("placeholder_strip", r"SELECT doc_id, CASE WHEN s = '' THEN t ELSE s END AS stripped FROM (SELECT doc_id, t, trim(regexp_replace(regexp_replace(t, '\[(?:EMAIL|URL|PHONE|USER)\]', ' ', 'g'), '\s+', ' ', 'g')) AS s FROM (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN '[USER]' ELSE '[URL] ' || lang || ' [EMAIL]  x' END AS t FROM documents))")
def placeholder_strip(spark, sf):
    t = F.when(F.col("doc_id") % 50 == 0, "[USER]").otherwise(F.concat(F.lit("[URL] "), "lang", F.lit(" [EMAIL]  x")))
    return table(spark, sf, "documents").select("doc_id", tx.stripped(t).alias("stripped"))


@query("masked_quotes", r"SELECT doc_id, substr(regexp_replace(text, '[0-9]', '#', 'g'), 1, 220) AS quote FROM documents")
def masked_quotes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.masked(F.col("text")).alias("quote"))


#: Shapes of a written date by event number: how Spark writes it, and what DuckDB keeps of the timestamp.
_WRITTEN = (
    ("yyyy-MM-dd'T'HH:mm:ss'Z'", "date_trunc('second', ts)"), ("yyyy-MM-dd", "date_trunc('day', ts)"), ("yyyyMMdd", "date_trunc('day', ts)"), ("yyyy/MM/dd", "date_trunc('day', ts)"),
    ("yyyy-MM-dd HH:mm", "date_trunc('minute', ts)"), ("dd-MM-yyyy", "date_trunc('day', ts)"), ("yyyy-MM-dd'T'HH:mm:ss'+05:30'", "date_trunc('second', ts) - INTERVAL 330 MINUTE"), ("'yesterday'", "NULL"), ("yyyy", "NULL"),
    # the day comes first where it can
    ("dd/MM/yyyy", "date_trunc('day', ts)"), ("MM/dd/yyyy HH:mm", "CASE WHEN day(ts) <= 12 THEN make_timestamp(year(ts), day(ts), month(ts), hour(ts), minute(ts), 0.0) ELSE date_trunc('minute', ts) END"),
)


def _pick(number, *values):
    """One of the values by a row number."""
    out = values[-1]
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(number % len(values) == i, v).otherwise(out)
    return out


def _pick_sql(number: str, *values: str) -> str:
    return f"CASE {number} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


@query("date_parse", f"SELECT event_id, CAST({_pick_sql('event_id', *[kept for _, kept in _WRITTEN])} AS TIMESTAMP) AS parsed FROM events")
def date_parse(spark, sf):
    """The events' timestamps, written in eleven ways and read again."""
    n = F.col("event_id")
    written = _pick(n, *[F.date_format("ts", shape) for shape, _ in _WRITTEN])
    return table(spark, sf, "events").select("event_id", parse.any_date(written).alias("parsed"))


_HALF = "CAST(round_even(value, 0) AS INTEGER)"


@query("rating_cast", f"SELECT event_id, {_pick_sql('event_id', _HALF, _HALF, 'CAST(-round_even(value, 0) AS INTEGER)', 'NULL', 'NULL', 'NULL', 'CAST(round_even(event_id + 0.5::DOUBLE, 0) AS INTEGER)')} AS rating FROM events")
def rating_cast(spark, sf):
    """The events' values as text: plain, padded, negative, not finite, with letters, empty, and halves."""
    v = F.col("value").cast("string")
    half = F.concat(F.col("event_id").cast("string"), F.lit(".5"))
    written = _pick(F.col("event_id"), v, F.concat(F.lit(" "), v, F.lit("\t")), F.concat(F.lit("-"), v), F.lit("inf"), F.concat(v, F.lit(" stars")), F.lit(""), half)
    return table(spark, sf, "events").select("event_id", parse.rating(written).alias("rating"))


@query("label_map", f"SELECT event_id, {_pick_sql('event_id', *[f'{chr(39)}{x}{chr(39)}' if x else 'NULL' for x in ('negative', 'negative', 'neutral', 'neutral', 'positive', 'positive', None, None, 'negative', 'neutral', 'positive', 'negative', 'positive', None)])} AS label FROM events")
def label_map(spark, sf):
    """Labels as star numbers, in short, in full, in capitals and padded; and what is none: numbers out of range and the events' types."""
    n = F.col("event_id")
    digit = (n % 14).cast("string")
    spelt = _pick(n, digit, digit, digit, digit, digit, digit, digit, F.lit(""), F.lit("NEG"), F.lit(" neu"), F.lit("Pos "), F.lit("Negative"), F.lit("POSITIVE"), F.col("event_type"))
    return table(spark, sf, "events").select("event_id", parse.label(spelt).alias("label"))


@query(
    "alias_ids",
    """WITH x AS (SELECT event_id + 1 AS pos, CASE event_id % 5 WHEN 0 THEN 'user-' || user_id WHEN 1 THEN 'x y' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE 'e_' || event_id END AS id, event_type AS text FROM events)
    SELECT pos, CASE WHEN pos % 5 IN (0, 1) AND row_number() OVER (PARTITION BY id ORDER BY pos) = 1 THEN id ELSE 'U' || CASE WHEN pos < 1000000 THEN lpad(CAST(pos AS VARCHAR), 6, '0') ELSE CAST(pos AS VARCHAR) END END AS review_id, text FROM x""",
)
def alias_ids(spark, sf):
    """Events under aliased headers: ids that repeat, are unsafe, blank or missing are replaced by the row's number."""
    from tidemark.sources.reviews import normalised

    n = F.col("event_id")
    own = _pick(n, F.concat(F.lit("user-"), F.col("user_id").cast("string")), F.lit("x y"), F.lit(""), F.lit(None).cast("string"), F.concat(F.lit("e_"), n.cast("string")))
    raw = table(spark, sf, "events").select((n + 1).alias("_pos"), own.alias("ID "), F.col("event_type").alias("Review"))
    return normalised(raw).select(F.col("_pos").alias("pos"), "review_id", "text")


_MOD = "list_reduce(list_transform(str_split(sha256(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))), ''), lambda c: instr('0123456789abcdef', c) - 1), lambda a, b: (a * 16 + b) % 100)"


@query("hash_split_sha256", f"SELECT doc_id, CASE WHEN v < 80 THEN 'train' WHEN v < 90 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, {_MOD} AS v FROM documents)")
def hash_split_sha256(spark, sf):
    return texts(spark, sf, "doc_id", "text").select("doc_id", parse.split_by_sha(F.col("text")).alias("split"))


_SPLIT3 = "CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END"


@query(
    "split_overlap",
    f"""WITH k AS (SELECT {_KEY} AS key, max(CAST(doc_id % 3 = 0 AS INT)) AS a, max(CAST(doc_id % 3 = 1 AS INT)) AS b, max(CAST(doc_id % 3 = 2 AS INT)) AS c FROM documents GROUP BY 1)
    SELECT 'train&val' AS pair, count(*) FILTER (WHERE a = 1 AND b = 1) AS shared FROM k UNION ALL SELECT 'train&test', count(*) FILTER (WHERE a = 1 AND c = 1) FROM k UNION ALL SELECT 'val&test', count(*) FILTER (WHERE b = 1 AND c = 1) FROM k""",
)
def split_overlap(spark, sf):
    """A split by number, which tears copies apart."""
    d = table(spark, sf, "documents").select(F.lower(parse.squeezed_ends(F.col("text"))).alias("key"), F.expr(_SPLIT3).alias("split"))
    return profile.split_overlap(d, "split", "key")


@query("split_overlap_by_text", f"SELECT pair, 0 * count(DISTINCT {_KEY}) AS shared FROM documents, (SELECT unnest(['train&val', 'train&test', 'val&test']) AS pair) GROUP BY 1")
def split_overlap_by_text(spark, sf):
    """A split by the text's hash shares nothing."""
    d = table(spark, sf, "documents").select(F.lower(parse.squeezed_ends(F.col("text"))).alias("key"), parse.split_by_sha(F.col("text")).alias("split"))
    return profile.split_overlap(d, "split", "key")


@query("hash_split_blake")
def hash_split_blake(spark, sf):
    return texts(spark, sf, "doc_id", "text").select("doc_id", parse.split_by_blake()(tx.group_key(F.col("text"))).alias("split"))


@query("pseudonymise", "SELECT c_custkey, 'user_' || substr(sha256(c_name), 1, 10) AS who FROM customer")
def pseudonymise(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", parse.pseudonym(F.col("c_name")).alias("who"))


@query("hashed_dates", "SELECT doc_id, TIMESTAMP '2024-01-01' + to_days(CAST(v % 360 AS INTEGER)) + to_seconds(CAST(v % 86400 AS INTEGER)) AS created_at FROM (SELECT doc_id, CAST('0x' || substr(sha256(text), 1, 8) AS BIGINT) AS v FROM documents)")
def hashed_dates(spark, sf):
    return table(spark, sf, "documents").select("doc_id", parse.hashed_date(F.col("text")).alias("created_at"))


_L = "length(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))"


@query(
    "profile_text",
    f"""SELECT count(*) AS rows, count(*) FILTER (WHERE {_L} = 0) AS empty_text, count(*) - count(DISTINCT {_KEY}) AS duplicate_texts, min({_L}) AS min_length, max({_L}) AS max_length,
    {r(f"avg({_L})", 2)} AS mean_length, quantile_cont({_L}, 0.5) AS median_length, {r(f"quantile_cont({_L}, 0.95)", 4)} AS p95_length, count(*) FILTER (WHERE contains(text, chr(65533))) AS replacement_char_rows,
    count(*) FILTER (WHERE contains(text, '&quot;') OR contains(text, '&amp;') OR contains(text, '&lt;') OR contains(text, '&gt;')) AS html_entity_rows,
    count(*) FILTER (WHERE contains(text, 'http://') OR contains(text, 'https://') OR contains(text, 'www.')) AS url_rows, count(*) FILTER (WHERE contains(text, '@')) AS mention_rows FROM documents""",
)
def profile_text(spark, sf):
    return profile.text_profile(texts(spark, sf, "text"), "text")


@query("profile_months", "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY 1")
def profile_months(spark, sf):
    return profile.months(table(spark, sf, "events"), "ts")


@query("profile_missing", "SELECT 'doc_id' AS column, count(*) FILTER (WHERE doc_id IS NULL) AS missing FROM documents UNION ALL SELECT 'text', count(*) FILTER (WHERE text IS NULL OR trim(text) = '') FROM documents UNION ALL SELECT 'lang', count(*) FILTER (WHERE lang IS NULL OR trim(lang) = '') FROM documents")
def profile_missing(spark, sf):
    return profile.missing(table(spark, sf, "documents"), ["doc_id", "text", "lang"])


@query("profile_labels", "SELECT CAST(toxic AS VARCHAR) AS value, count(*) AS n FROM labels GROUP BY 1")
def profile_labels(spark, sf):
    return profile.distribution(table(spark, sf, "labels"), "toxic")


@query("conflicting_ids", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def conflicting_ids(spark, sf):
    return profile.conflicts(table(spark, sf, "lineitem"), "l_orderkey", "l_returnflag")


@query("consistent_rows", "WITH a AS (SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1)), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = 1) SELECT l_orderkey, l_partkey, l_returnflag FROM b WHERE l_partkey NOT IN (SELECT l_partkey FROM b GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1)")
def consistent_rows(spark, sf):
    """Line numbers repeat within an order: of equal ones the first in the files counts, in the order of their names."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linenumber", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return profile.consistent(rows, "l_orderkey", "l_partkey", "l_returnflag", "l_linenumber", "_file", "_row").select("l_orderkey", "l_partkey", "l_returnflag")


@query("seeded_sample", "SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('42:' || o_orderkey), o_orderkey) <= 10")
def seeded_sample(spark, sf):
    return profile.seeded_sample(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey", 10).select("o_orderkey", "o_orderpriority")


@query("balanced_rows", "WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1) SELECT toxic, max(n) OVER () AS n FROM c")
def balanced_rows(spark, sf):
    return profile.balanced(table(spark, sf, "labels"), "toxic", "doc_id").groupBy("toxic").agg(F.count("*").alias("n"))


@query("class_weights", f"WITH s AS (SELECT unnest(['negative', 'neutral', 'positive']) AS label), c AS (SELECT s.label, count(l.doc_id) AS n FROM s LEFT JOIN labels l ON s.label = (CASE WHEN l.toxic = 1 THEN 'negative' ELSE 'positive' END) GROUP BY 1), w AS (SELECT label, sqrt((SELECT sum(n) FROM c) / (3.0 * greatest(n, 1))) AS raw FROM c) SELECT label, {r('raw / avg(raw) OVER ()', 6)} AS weight FROM w")
def class_weights(spark, sf):
    d = table(spark, sf, "labels").select(F.when(F.col("toxic") == 1, "negative").otherwise("positive").alias("label"))
    return scoring.class_weights(d).select("label", rounded(F.col("weight"), 6).alias("weight"))


@query("dates_available", "SELECT count(*) AS dated, count(*) AS n, true AS available FROM events")
def dates_available(spark, sf):
    return clean.dates_available(table(spark, sf, "events").withColumnRenamed("ts", "created_at"))


@query("even_sample", "WITH i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id FROM i WHERE i IN (SELECT CAST(round_even(k * ((SELECT max(n) FROM i) - 1) / 99.0, 0) AS BIGINT) FROM range(100) t(k))")
def even_sample(spark, sf):
    return clean.even_sample(table(spark, sf, "documents"), 100, "doc_id").select("doc_id")


@query("stars_to_sentiment", "SELECT DISTINCT event_id % 7 AS stars, CASE WHEN event_id % 7 <= 2 THEN 'negative' WHEN event_id % 7 = 3 THEN 'neutral' ELSE 'positive' END AS sentiment FROM events")
def stars_to_sentiment(spark, sf):
    return table(spark, sf, "events").select((F.col("event_id") % 7).alias("stars")).distinct().withColumn("sentiment", parse.stars(F.col("stars")))


_LEX = {n: "[" + ", ".join(f"'{w}'" for w in words) + "]" for n, words in (("bad", scoring.BAD), ("good", scoring.GOOD))}
_COUNT = {n: f"exp(least(len(list_filter(ws, lambda w: list_contains({known}, w)))::DOUBLE, 20.0))" for n, known in _LEX.items()}


@query(
    "lexicon_scores",
    f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM documents), e AS (SELECT doc_id, {_COUNT["bad"]} AS a, exp(0.5::DOUBLE) AS b, {_COUNT["good"]} AS c FROM w),
    p AS (SELECT doc_id, a / (a + b + c) AS x, b / (a + b + c) AS y, c / (a + b + c) AS z FROM e)
    SELECT doc_id, {r("x", 4)} AS p_negative, {r("y", 4)} AS p_neutral, {r("z", 4)} AS p_positive, CASE WHEN x >= y AND x >= z THEN 'negative' WHEN y >= z THEN 'neutral' ELSE 'positive' END AS sentiment, {r("greatest(x, y, z)", 4)} AS confidence FROM p""",
)
def lexicon_scores(spark, sf):
    d = texts(spark, sf, "doc_id", "text").select("doc_id", "text")
    return scoring.distinct_scored(d, "text", scoring.lexicon).drop("text")
