"""URL filters: host and path rules first, a ratio of two character language models for the rest.

The urls that a rule decides are the labelled ones. Three sixteenths of them (by a digest of the url) are held out; on the
others one variable-order Markov model of characters is trained for the accepted and one for the rejected.
A url (host and path, digits alike) is judged by its log-likelihood difference per character against a cutoff that is
calibrated on the held-out urls: the one at which the shares of rejected and of accepted urls below it differ most.

The models. A context is what stands before a character, up to ORDER characters. With n characters seen after it, d
different ones, and c times the character in question, Witten and Bell's estimate is

    P(char | context) = (c + e P(char | context without its first character)) / (n + d)

where e is d plus the counts of followers that are not kept, and the empty context leans on 1 / ALPHABET. Only strings seen at
least once in 1 / STRINGS of a model's characters are kept, in either model: so contexts are as long as the data bear (variable order), and the
table has at most 2 STRINGS rows of each length, however large the corpus: 200,000 rows of at most 5 characters. That bound is
why it may be broadcast.

Scoring is one join. Let L(s) be the log-probability of the last character of string s after the others, and E(s) the log of e / (n + d) of s
as a context. If every kept string s in a url counts L(s) - L(s without its first character) - E(s without its last), and E(s) where
something follows, then at each place the terms of shorter strings cancel, and what is left is L of the longest kept string and the backing off from longer
contexts: the exact log-likelihood. So the url is a sum of weights of its substrings. Weights are whole millionths, so
sums don't depend on the order. Kept strings are closed under taking prefixes and suffixes, since those are at least as frequent.

Main path: DataFrame functions only. Substrings are made a row at a time and meet the broadcast table in
the task that made them; one row per url (a map-side combined sum) is shuffled. Training counts are map-side combined too.

Edge cases: a null url or one without :// has an empty host and path and is judged as the empty url; repeated rows are judged alike, and
each counts in training; a null page_id is carried; very long urls are cut into pieces that overlap, so work is linear but for finding the pieces;
if the rules leave no accepted or no rejected url to train on, nothing is scored (0) and what no rule decides is allowed; without held-out urls on both
sides the cutoff is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.llm.common import cut, table

#: (verdict, host, start of the path); the longest that fits wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDER = 4
ALPHABET = 256
STRINGS = 1 << 14
HELD = 3  # sixteenths of the labelled urls
#: Characters of a url that one piece holds.
PIECE = 1024
START, END = "\x02", "\x03"
MICRO = 1_000_000
#: The cutoff is a multiple of one thousandth, within these.
LEAST, MOST = -20_000, 20_000


def parts(pages: DataFrame) -> DataFrame:
    """page_id, host, path of every row."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract("url", pattern, i), F.lit("")) for i in (1, 2))
    return pages.select("page_id", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), path.alias("path"))


def decided(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for word, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return rule, verdict


def _spelled(host: Column, path: Column) -> Column:
    """What the models read: all digits as 0, between a start and an end."""
    plain = F.translate(F.concat(host, path), f"123456789{START}{END}", "000000000  ")
    return F.concat(F.lit(START), plain, F.lit(END))


def strings(rows: DataFrame, *keep: str) -> DataFrame:
    """keep and s for all substrings of up to ORDER + 1 characters of the column text; the empty one once for each character but the start."""
    size = F.length("text")
    out = rows.select(*keep, "text", F.explode(F.sequence(F.lit(1), size, F.lit(PIECE))).alias("from"))
    out = out.select(*keep, F.substring(F.col("text"), F.col("from"), F.lit(PIECE + ORDER)).alias("piece"), (F.col("from") == 1).alias("first"), F.least(F.lit(PIECE), size - F.col("from") + 1).alias("places"))
    out = out.select(*keep, "piece", "first", F.explode(F.sequence(F.lit(1), F.col("places"))).alias("place"))
    at = F.substring(F.col("piece"), F.col("place"), F.lit(ORDER + 1))
    predicted = ~F.col("first") | (F.col("place") > 1)
    out = out.select(*keep, at.alias("at"), F.explode(F.sequence(F.when(predicted, 0).otherwise(1), F.length(at))).alias("k"))
    return out.select(*keep, F.substring(F.col("at"), F.lit(1), F.col("k")).alias("s"))


def weights(labelled: DataFrame, kept: int = STRINGS) -> DataFrame | None:
    """s, weight: the log-likelihood difference of accepted and rejected as a sum over substrings, in millionths. labelled: text, accepted."""
    ok = F.col("accepted")
    counts = strings(labelled, "accepted").groupBy("s").agg(F.count_if(ok).alias("ca"), F.count_if(~ok).alias("cr"))
    counts = cut(counts)
    total = counts.where("s = ''").select("ca", "cr").first()
    if total is None or not total.ca or not total.cr:
        return None
    counts = counts.withColumn("kept", (F.col("ca") * kept >= total.ca) & (F.col("ca") > 0) | (F.col("cr") * kept >= total.cr) & (F.col("cr") > 0))
    known = counts.where("kept").drop("kept")
    # of each context: the different followers, and the counts of those that are kept
    n = F.length("s")
    ahead = counts.where((n > 0) & (F.col("s") != START)).select(F.substring(F.col("s"), F.lit(1), n - 1).alias("s"), *[c for k in "ar" for c in (f"c{k}", F.when(F.col("kept"), F.col(f"c{k}")).otherwise(0).alias(f"k{k}"))])
    ahead = ahead.groupBy("s").agg(*[f for k in "ar" for f in (F.count_if(F.col(f"c{k}") > 0).alias(f"d{k}"), F.sum(f"k{k}").alias(f"k{k}"))])
    context = known.join(ahead, "s", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    seen = [(F.col(f"c{k}") + zero(f"d{k}")).alias(f"m{k}") for k in "ar"]
    # a context without followers (it ends a url) passes everything on
    back = [F.when(zero(f"d{k}") > 0, (F.col(f"c{k}") + zero(f"d{k}") - zero(f"k{k}")) / (F.col(f"c{k}") + zero(f"d{k}"))).otherwise(1.0).alias(f"b{k}") for k in "ar"]
    context = cut(context.select("s", "ca", "cr", *seen, *back))
    own = known.where((n > 0) & (F.col("s") != START)).select("s", "ca", "cr", F.substring(F.col("s"), F.lit(1), n - 1).alias("before"))
    under = context.select(F.col("s").alias("before"), "ma", "mr", "ba", "br")
    own = own.join(under, "before").select("s", *[x for k in "ar" for x in (F.when(F.col(f"m{k}") > 0, F.col(f"c{k}") / F.col(f"m{k}")).otherwise(0.0).alias(f"a{k}"), F.col(f"b{k}"))])
    # the chain of suffixes of each string, from the last character on
    chain = own.select("s").select(F.col("s").alias("whole"), F.explode(F.sequence(F.lit(1), n)).alias("k"))
    chain = chain.select("whole", "k", F.expr("right(whole, k)").alias("s")).join(own, "s").groupBy("whole").agg(F.sort_array(F.collect_list(F.struct("k", "aa", "ba", "ar", "br"))).alias("chain"))

    def step(k: str):
        def likelihood(entries: Column) -> Column:
            return F.aggregate(entries, F.lit(1.0 / ALPHABET), lambda p, e: e[f"a{k}"] + e[f"b{k}"] * p)

        short = F.slice(F.col("chain"), F.lit(1), F.size("chain") - 1)
        return F.log(likelihood(F.col("chain"))) - F.log(likelihood(short)) - F.log(F.element_at("chain", -1)[f"b{k}"])

    gain = chain.select(F.col("whole").alias("s"), (step("a") - step("r")).alias("gain"))
    follow = context.select("s", (F.log("ba") - F.log("br")).alias("back"))
    both = follow.join(gain, "s", "left").select("s", F.round((F.coalesce(F.col("gain"), F.lit(0.0)) + F.col("back")) * MICRO).cast("long").alias("weight"))
    return cut(both)


def scored(rows: DataFrame, model: DataFrame | None, *keep: str) -> DataFrame:
    """keep and micro: millionths of log-likelihood difference per character of the column text, rounded down."""
    if model is None:
        return rows.select(*keep, F.lit(0).cast("long").alias("micro"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    size = (F.length("text") - 1).cast("long").alias("size")
    met = strings(rows.select("_row", *keep, "text", size), "_row", "size", *keep).join(F.broadcast(model), "s", "left")
    out = met.groupBy("_row", "size", *keep).agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("sum"))
    return out.select(*keep, F.floor(F.col("sum") / F.col("size")).cast("long").alias("micro"))


def cutoff(held: DataFrame) -> int:
    """Millionths below which a url is rejected. held: micro, accepted."""
    bin_ = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.floor(F.col("micro") / 1000))).cast("int")
    bins = held.groupBy(bin_.alias("bin")).agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    all_ = Window.partitionBy(F.lit(0))  # at most MOST - LEAST rows
    upto = all_.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = bins.select("bin", *[f(c).over(w).alias(f"{x}{c}") for c in "ar" for x, f, w in (("n", F.sum, all_), ("u", F.sum, upto))])
    total = total.where("na > 0 AND nr > 0").withColumn("gain", F.col("ur") * F.col("na") - F.col("ua") * F.col("nr")).where("gain > 0")
    best = total.orderBy(F.desc("gain"), F.abs("bin"), "bin").first()
    return 0 if best is None else (best.bin + 1) * 1000


def judge(pages: DataFrame, rules=RULES, kept: int = STRINGS) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log-likelihood difference per character)."""
    rows = parts(pages)
    rule, verdict = decided(rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("said"), _spelled(F.col("host"), F.col("path")).alias("text"))
    held = F.conv(F.substring(F.md5("text"), 1, 1), 16, 10).cast("int") < HELD
    rows = cut(rows.withColumn("held", held))
    accepted = (F.col("said") == "allow").alias("accepted")
    model = weights(rows.where("said IS NOT NULL AND NOT held").select("text", accepted), kept)
    out = cut(scored(rows, model, "page_id", "host", "path", "rule", "said", "held"))
    least = cutoff(out.where("said IS NOT NULL AND held").select("micro", accepted))
    own = F.when(F.lit(model is not None) & (F.col("micro") < least), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", own).alias("verdict"), (F.col("micro") / MICRO).alias("score"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


_CHECK = """
WITH u AS (
  SELECT row_number() OVER () AS r, page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages),
j AS (
  SELECT *, CASE WHEN ('.' || host).ends_with('.example.net') AND path.starts_with('/en/') THEN 'example.net/en/'
                 WHEN ('.' || host).ends_with('.example.com') AND path.starts_with('/de/') THEN 'example.com/de/'
                 WHEN ('.' || host).ends_with('.org') AND path.starts_with('/fr/') THEN 'org/fr/'
                 WHEN ('.' || host).ends_with('.net') AND path.starts_with('/') THEN 'net/' END AS rule,
         chr(2) || translate(host || path, '123456789' || chr(2) || chr(3), '000000000  ') || chr(3) AS text FROM u),
t AS (SELECT *, rule IN ('example.net/en/', 'org/fr/') AS ok, substr(md5(text), 1, 1) IN ('0', '1', '2') AS held FROM j),
p AS (SELECT r, text, unnest(range(1, len(text) + 1)) AS i FROM t),
g AS (SELECT r, substr(text, i, k) AS s FROM (SELECT r, text, i, unnest(range((i = 1)::INT, least(5, len(text) - i + 1) + 1)) AS k FROM p)),
c AS (SELECT s, count(*) FILTER (ok) AS ca, count(*) FILTER (NOT ok) AS cr FROM g JOIN t USING (r) WHERE rule IS NOT NULL AND NOT held GROUP BY s),
n AS (SELECT ca AS na, cr AS nr FROM c WHERE s = '' AND ca > 0 AND cr > 0),
kc AS (SELECT s, ca, cr, (ca * 16384 >= na AND ca > 0) OR (cr * 16384 >= nr AND cr > 0) AS kept FROM c, n),
d AS (
  SELECT substr(s, 1, len(s) - 1) AS s, count(*) FILTER (ca > 0) AS da, count(*) FILTER (cr > 0) AS dr,
         coalesce(sum(ca) FILTER (kept), 0) AS ka, coalesce(sum(cr) FILTER (kept), 0) AS kr FROM kc WHERE s <> '' AND s <> chr(2) GROUP BY 1),
x AS (
  SELECT kc.s, ca + coalesce(da, 0) AS ma, cr + coalesce(dr, 0) AS mr,
         CASE WHEN coalesce(da, 0) > 0 THEN (ca + da - ka)::DOUBLE / (ca + da) ELSE 1.0::DOUBLE END AS ba,
         CASE WHEN coalesce(dr, 0) > 0 THEN (cr + dr - kr)::DOUBLE / (cr + dr) ELSE 1.0::DOUBLE END AS br
  FROM kc LEFT JOIN d USING (s) WHERE kept),
o AS (
  SELECT kc.s, CASE WHEN ma > 0 THEN ca::DOUBLE / ma ELSE 0.0::DOUBLE END AS aa, ba, CASE WHEN mr > 0 THEN cr::DOUBLE / mr ELSE 0.0::DOUBLE END AS ar, br
  FROM kc JOIN x ON x.s = substr(kc.s, 1, len(kc.s) - 1) WHERE kept AND kc.s <> '' AND kc.s <> chr(2)),
h AS (
  SELECT w.s AS whole, list(struct_pack(a := o.aa, b := o.ba) ORDER BY k) AS la, list(struct_pack(a := o.ar, b := o.br) ORDER BY k) AS lr
  FROM (SELECT s, unnest(range(1, len(s) + 1)) AS k FROM o) w JOIN o ON o.s = right(w.s, k) GROUP BY w.s),
m AS (
  SELECT whole, ln(list_reduce(list_prepend(struct_pack(a := 1 / 256.0::DOUBLE, b := 1.0::DOUBLE), la), lambda q, e: struct_pack(a := e.a + e.b * q.a, b := 1.0::DOUBLE)).a)
         - ln(list_reduce(list_prepend(struct_pack(a := 1 / 256.0::DOUBLE, b := 1.0::DOUBLE), la[:-2]), lambda q, e: struct_pack(a := e.a + e.b * q.a, b := 1.0::DOUBLE)).a) - ln(la[-1].b)
         - ln(list_reduce(list_prepend(struct_pack(a := 1 / 256.0::DOUBLE, b := 1.0::DOUBLE), lr), lambda q, e: struct_pack(a := e.a + e.b * q.a, b := 1.0::DOUBLE)).a)
         + ln(list_reduce(list_prepend(struct_pack(a := 1 / 256.0::DOUBLE, b := 1.0::DOUBLE), lr[:-2]), lambda q, e: struct_pack(a := e.a + e.b * q.a, b := 1.0::DOUBLE)).a) + ln(lr[-1].b) AS gain FROM h),
w AS (SELECT x.s, round((coalesce(gain, 0) + ln(ba) - ln(br)) * 1000000)::BIGINT AS weight FROM x LEFT JOIN m ON m.whole = x.s),
z AS (SELECT r, floor(coalesce(sum(weight), 0)::DOUBLE / (len(any_value(text)) - 1))::BIGINT AS micro FROM g JOIN t USING (r) LEFT JOIN w USING (s) GROUP BY r),
e AS (SELECT greatest(-20000, least(20000, floor(micro / 1000.0::DOUBLE)))::INT AS bin, count(*) FILTER (ok) AS a, count(*) FILTER (NOT ok) AS b FROM z JOIN t USING (r) WHERE rule IS NOT NULL AND held GROUP BY 1),
f AS (SELECT bin, sum(a) OVER () AS na, sum(b) OVER () AS nb, sum(a) OVER (ORDER BY bin) AS ua, sum(b) OVER (ORDER BY bin) AS ub FROM e),
y AS (SELECT bin FROM f WHERE na > 0 AND nb > 0 AND ub * na - ua * nb > 0 ORDER BY ub * na - ua * nb DESC, abs(bin), bin LIMIT 1),
l AS (SELECT coalesce((SELECT (bin + 1) * 1000 FROM y), 0) AS least_)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN micro < least_ AND EXISTS (SELECT 1 FROM n) THEN 'block' ELSE 'allow' END AS verdict,
       micro / 1000000.0::DOUBLE AS score
FROM t JOIN z USING (r), l
"""

SQL = {"op12_url_filters": _CHECK}
