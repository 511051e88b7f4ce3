"""The registered queries of the training-data operators, and SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, balanced, conversations, langid, linededup, matroska, mixing, packing, periods, secrets, simhash, substring, urlfilter
from .common import docs_table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = matroska.text_media(docs_table(spark, sf_dir))
    return media.withColumn("d", matroska.digest("media")).select("doc_id", "n_bytes", "d.payload_bytes", "d.payload_sha256", "d.tail_crc32", "d.media_bytes", "d.media_sha256", "d.feature", "d.packets")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(docs_table(spark, sf_dir))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(docs_table(spark, sf_dir)).drop("kept")


def _list_number(text: F.Column) -> F.Column:
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("int")


def captures_of(pages: DataFrame) -> DataFrame:
    """The pages with a fetch time in 2024, by their ids: the table has none of its own."""
    return pages.select("page_id", "url", F.expr("timestampadd(MINUTE, page_id * 7919 % 525600, timestamp '2024-01-01 00:00:00')").alias("fetched_at"))


def list_events_of(pages: DataFrame) -> DataFrame:
    """A dated block and allow list over the hosts, domains and first path parts of the pages: the tables have none."""
    url = F.col("url")
    seen = pages.select(urlfilter.host_of(url).alias("host"), F.regexp_extract(urlfilter.path_of(url), "^/([^/]+)", 1).alias("part")).where("host <> ''").distinct()
    hosts = seen.select("host").distinct().withColumn("v", _list_number(F.col("host")))
    domains = hosts.select(F.regexp_replace("host", r"^[^.]*\.", "").alias("host")).where("host like '%.%.%'").distinct().withColumn("v", _list_number(F.concat(F.lit("d"), F.col("host"))))
    parts = seen.where("part <> ''").select(F.concat_ws("/", "host", "part").alias("host")).withColumn("v", _list_number(F.concat(F.lit("p"), F.col("host"))))
    dated = lambda df, verdict, action, day: df.select(F.col("host").alias("entry"), F.lit(verdict).alias("verdict"), F.lit(action).alias("action"), F.expr(f"timestampadd(DAY, {day}, timestamp '2024-01-01 00:00:00')").alias("at"))
    out = dated(hosts.where("v % 4 < 2"), "block", "add", "v % 200")
    out = out.union(dated(hosts.where("v % 4 < 2"), "block", "remove", "v % 200 + 30 + v % 50"))
    out = out.union(dated(hosts.where("v % 4 = 0"), "block", "add", "v % 200 + 120"))
    out = out.union(dated(domains.where("v % 5 = 0"), "block", "add", "v % 300"))
    return out.union(dated(parts.where("v % 3 = 0"), "allow", "add", "v % 150"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = docs_table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(captures_of(pages), list_events_of(pages), "page_id")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(docs_table(spark, sf_dir), vocabulary())


#: Parts of each domain's tokens that the mix is to hold.
SHARES = {"good": 1.0, "poor": 0.25, "toxic": 0.0}


def op6_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = mixing.label_domains(docs_table(spark, sf_dir, "labels"))
    rows, names = mixing.mix(docs_table(spark, sf_dir), labels, SHARES)
    return rows.select("doc_id", "tokens", "rate", *[F.col("posterior")[i].alias(f"p_{c}") for i, c in enumerate(names)])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.clean(docs_table(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def planted_findings_of(docs: DataFrame, labels: DataFrame, bound: int = secrets.LABELLED) -> DataFrame:
    """(text, finding, label): findings that are known because they were put there, in words around a place of the labelled documents.

    The tables have no verdicts on findings. So each document of `labels` (about `bound` at most, by hash) lends the ten
    words before and after one of its places to one made secret and one made harmless string, of forms that come with and
    without a name, an assignment and quotes: neither form nor surroundings alone tell which it is.
    """
    share = "pmod(xxhash64(doc_id), 1000003) < {bound} / greatest(1, n) * 1000003"
    seen = labels.select("doc_id").distinct().join(docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text")), "doc_id")
    seen = seen.crossJoin(F.broadcast(labels.agg(F.count_distinct("doc_id").alias("n")))).where(F.expr(share.format(bound=bound)))  # n: one row
    words = seen.select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "").alias("w"))
    at = words.withColumn("p", F.expr("cast(pmod(xxhash64(doc_id, 3), size(w) + 1) as int)"))
    around = at.select("doc_id", F.expr("slice(w, greatest(1, p - 9), p - greatest(1, p - 9) + 1)").alias("left"), F.expr("slice(w, p + 1, 10)").alias("right"), *[F.expr(f"sha2(concat(doc_id, '{c}'), 256)").alias(f"x{i}") for i, c in enumerate("ab")])
    made = lambda x: {
        "hex": F.substring(x, 1, 40), "long": x, "plain": F.substring(F.regexp_replace(F.base64(F.unhex(x)), "[+/=]", "7"), 1, 24), "short": F.substring(F.regexp_replace(F.base64(F.unhex(x)), "[+/=]", "k"), 3, 11), "upper": F.concat(F.lit("AKIA"), F.substring(F.upper(F.regexp_replace(F.base64(F.unhex(x)), "[+/=]", "Q")), 1, 16)),
        "small": F.lower(F.substring(F.regexp_replace(F.base64(F.unhex(x)), "[+/=]", "z"), 9, 7)), "uuid": F.concat_ws("-", F.substring(x, 1, 8), F.substring(x, 9, 4), F.substring(x, 13, 4), F.substring(x, 17, 4), F.substring(x, 21, 12)), "number": F.conv(F.substring(x, 1, 5), 16, 10), "date": F.concat(F.lit("20"), F.lpad(F.conv(F.substring(x, 1, 1), 16, 10), 2, "0"), F.lit("-02-11")),
        "path": F.concat(F.lit("src/part"), F.substring(x, 1, 2), F.lit("/file"), F.substring(x, 3, 2), F.lit(".java")), "mail": F.concat(F.lit("name"), F.substring(x, 1, 3), F.lit("@site.org")), "version": F.concat_ws(".", F.conv(F.substring(x, 1, 1), 16, 10), F.conv(F.substring(x, 2, 1), 16, 10), F.conv(F.substring(x, 3, 1), 16, 10)), "example": F.concat(F.lit("example"), F.substring(x, 1, 1)),
    }
    # Forms of a secret and of what looks like one; {} is the string itself.
    real = [("hex", 'token = "{}"'), ("plain", "api_key={}"), ("short", "password: {}"), ("upper", "uses {} there"), ("plain", "Bearer {}"), ("hex", '"secret":"{}"'), ("small", "pwd={}"), ("long", "key = {}"), ("short", "'password': '{}'"), ("hex", "{}"), ("plain", "secret = '{}'"), ("upper", "key={}")]
    fake = [("hex", "commit {}"), ("long", "sha256:{}"), ("uuid", "id = {}"), ("path", "in {}"), ("number", "number {}"), ("version", "version {}"), ("mail", "mail {}"), ("number", "key = {}"), ("example", "token = {}"), ("date", "on {}"), ("path", "https://host.org/{}"), ("number", "password: {}"), ("uuid", '"id":"{}"'), ("hex", "checksum = {}")]
    pick = lambda forms, x, salt: F.element_at(F.array(*[F.struct(made(F.col(x))[k].alias("finding"), F.lit(f).alias("form")) for k, f in forms]), (F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(len(forms))) + 1).cast("int"))
    both = around.select("left", "right", F.explode(F.array(F.struct(pick(real, "x0", 1).alias("f"), F.lit(1).alias("label")), F.struct(pick(fake, "x1", 2).alias("f"), F.lit(0).alias("label")))).alias("e"))
    text = F.concat_ws(" ", F.array_join("left", " "), F.replace(F.col("e.f.form"), F.lit("{}"), F.col("e.f.finding")), F.array_join("right", " "))
    finding = F.when(F.col("e.f.form").startswith("https"), F.concat(F.lit("//host.org/"), F.col("e.f.finding"))).otherwise(F.col("e.f.finding"))
    return both.select(text.alias("text"), finding.alias("finding"), "e.label")


def repeated_findings_of(found: DataFrame, labels: DataFrame, often: int = 3) -> DataFrame:
    """What stands in `often` or more of the labelled documents is shared by them and no secret of one."""
    reviewed = found.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    shared = reviewed.select("finding", "doc_id").distinct().groupBy("finding").count().where(F.col("count") >= often).select("finding")
    return reviewed.join(shared, "finding", "left_semi").select("doc_id", "at", "finding", F.lit(0).alias("label"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = docs_table(spark, sf_dir).select("doc_id", "text"), docs_table(spark, sf_dir, "labels")
    found = secrets.scan(docs, lambda c: repeated_findings_of(c, labels), examples=planted_findings_of(docs, labels))
    return found.select("doc_id", F.col("at").alias("word"), F.char_length("finding").alias("n_chars"), F.sha2("finding", 256).alias("finding_sha256"), "score", "is_secret")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(docs_table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(docs_table(spark, sf_dir))


def op11_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced.pack(docs_table(spark, sf_dir), vocabulary())


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by a checksum of doc_id, repeat a stretch of their words from some word on; a null id counts as empty."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    n = F.size("words")
    a = F.expr("floor(h / 10) % size(words)")
    some = some.withColumn("a", F.when(n > 0, a).cast("int"))
    p = F.expr("1 + floor((size(words) - a) / (3 + floor(h / 10) % 8))").cast("int")
    some = some.withColumn("p", F.when(n > 0, p))
    moved = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, words[a + (i - a) % p])), ' ')")
    return some.select("doc_id", F.when(n > 0, moved).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.find_runs(with_planted_runs(docs_table(spark, sf_dir)))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    ahead = F.expr("array_sort(runs, (x, y) -> case when x.length <> y.length then if(x.length > y.length, -1, 1) when x.start <> y.start then if(x.start < y.start, -1, 1) else if(x.period < y.period, -1, 1) end)[0]")
    top = found.withColumn("top", F.when(F.size("runs") > 0, ahead))
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.expr("floor(1000 * top.length / top.period)").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns lost, emptied, cut off, repeated or given to the user, by a checksum of `conv_id:turn`; a null is one space."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hurt = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20
    text = F.when(F.col("hurt") == 1, "").when(F.col("hurt") == 2, F.regexp_replace(named("text"), "[.!?]", "")).otherwise(named("text"))
    role = F.when(F.col("hurt") == 4, "user").otherwise(named("role"))
    times = F.when(F.col("hurt") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.withColumn("hurt", hurt).where("hurt <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = docs_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hurt = damaged(whole)
    judged, rows = conversations.repair_conversations(hurt)
    gaps = hurt.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"))
    out = whole.select("conv_id").distinct()
    for df in (gaps, judged, conversations.digests(rows)):
        other = df.withColumnRenamed("conv_id", "c")
        out = out.join(other, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {
    "op1_media_columns": op1_media_columns,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_url_filters": op4_url_filters,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_mixing_weights": op6_mixing_weights,
    "op7_line_dedup": op7_line_dedup,
    "op8_secret_scans": op8_secret_scans,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_language_id": op10_language_id,
    "op11_balanced_packing": op11_balanced_packing,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op4_url_filters": """
        WITH c AS (
            SELECT page_id, lower(url) AS u, TIMESTAMP '2024-01-01' + to_minutes(page_id * 7919 % 525600) AS t,
                rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '.') AS host,
                list_filter(string_split(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS parts
            FROM pages),
        hosts AS (SELECT DISTINCT host AS entry, ('0x' || left(md5(host), 6))::INT AS v FROM c WHERE host <> ''),
        domains AS (
            SELECT DISTINCT entry, ('0x' || left(md5('d' || entry), 6))::INT AS v
            FROM (SELECT regexp_replace(entry, '^[^.]*\\.', '') AS entry FROM hosts) WHERE entry LIKE '%.%.%'),
        parts AS (
            SELECT DISTINCT entry, ('0x' || left(md5('p' || entry), 6))::INT AS v
            FROM (SELECT host || '/' || parts[1] AS entry FROM c WHERE host <> '' AND len(parts) > 0)),
        spans AS (
            SELECT entry, 'block' AS verdict, v % 200 AS a, v % 200 + 30 + v % 50 AS z FROM hosts WHERE v % 4 < 2
            UNION ALL SELECT entry, 'block', v % 200 + 120, 100000 FROM hosts WHERE v % 4 = 0
            UNION ALL SELECT entry, 'block', v % 300, 100000 FROM domains WHERE v % 5 = 0
            UNION ALL SELECT entry, 'allow', v % 150, 100000 FROM parts WHERE v % 3 = 0),
        m AS (
            SELECT c.page_id, s.verdict, s.entry, TIMESTAMP '2024-01-01' + to_days(s.a::INT) AS valid_from,
                CASE WHEN s.entry LIKE '%/%' THEN 100 ELSE 0 END + CASE WHEN s.entry = c.host THEN 99 ELSE len(s.entry) / 1000.0 END AS weight
            FROM c JOIN spans AS s ON c.host <> '' AND (s.entry = c.host OR c.host LIKE '%.' || s.entry OR s.entry = c.host || '/' || parts[1])
            WHERE c.t >= TIMESTAMP '2024-01-01' + to_days(s.a::INT) AND c.t < TIMESTAMP '2024-01-01' + to_days(s.z::INT)),
        b AS (
            SELECT page_id, arg_max({'verdict': verdict, 'entry': entry, 'valid_from': valid_from}, weight) AS x, count(*) AS n FROM m GROUP BY page_id)
        SELECT c.page_id, c.host, c.t AS fetched_at, coalesce(b.x.verdict, 'none') AS verdict, b.x.entry AS entry,
            b.x.valid_from AS valid_from, coalesce(b.n, 0) AS n_active
        FROM c LEFT JOIN b USING (page_id)
    """,
    "op7_line_dedup": """
        WITH l AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no
            FROM documents WHERE text IS NOT NULL),
        d AS (
            SELECT line, min(doc_id * 1000000 + no) AS first, length(line) AS n FROM l WHERE regexp_matches(line, '[\\p{L}\\p{N}]') GROUP BY line),
        h AS (
            SELECT line, first, n, b, side, CASE WHEN side = 0 THEN left(line, b // 2) ELSE right(line, b // 2) END AS half
            FROM (SELECT *, unnest([n, n - 1]) AS b FROM d), (VALUES (0), (1)) AS s(side)),
        near AS (
            SELECT DISTINCT y.first FROM h AS x JOIN h AS y ON x.b = y.b AND x.side = y.side AND x.half = y.half AND x.first < y.first
            WHERE len(list_filter(range(greatest(x.n, y.n)), lambda i: left(x.line, i) = left(y.line, i) AND right(x.line, greatest(x.n, y.n) - i - 1) = right(y.line, greatest(x.n, y.n) - i - 1))) > 0),
        kept AS (SELECT first FROM d WHERE first NOT IN (SELECT first FROM near)),
        r AS (
            SELECT l.doc_id, l.no, l.line, NOT regexp_matches(l.line, '[\\p{L}\\p{N}]') OR k.first IS NOT NULL AS stays
            FROM l LEFT JOIN kept AS k ON k.first = l.doc_id * 1000000 + l.no)
        SELECT doc_id, count(line) AS n_lines, count(line) - count(line) FILTER (stays) AS n_removed,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (stays), '')) AS kept_sha256
        FROM documents LEFT JOIN r USING (doc_id) GROUP BY doc_id
    """,
}
