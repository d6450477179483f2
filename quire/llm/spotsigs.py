"""Document fingerprints by spot signatures, in DataFrame functions.

A signature is an anchor (a common word) with the content words that follow it, up to ``CHAIN`` of them,
further common words left out. A document's fingerprint is the set of its signatures. Texts
without any anchor before a content word have one signature of all their words; texts without words have none.
Two fingerprints are compared by the Jaccard similarity of their sets. ``similar`` finds
pairs: sets are dealt by their length to partitions so wide that similar lengths lie in the same or the next one,
and only pairs whose lengths and rarest signatures allow the similarity are compared. Its classes and links are columns of the query.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "the of and to in a is that it for on was be with as by this at are an from or not have "
    "le la les de des du un une et en que qui dans pour pas sur avec est sont au aux ce il elle "
    "der die das den dem ein eine und von zu mit nicht auf ist als auch sich für im es "
    "el los las del y por con para una su se lo al como más"
).split()
CHAIN = 3
#: Least similarity of a link, hash buckets that order the signatures, sets of one signature that a piece holds.
LINKED, BUCKETS, PIECE = 0.8, 1 << 16, 1024
#: Signatures beyond which a set counts as more than one in its piece, and most sets of a signature whose pairs are rows.
WHOLE, FEW = 128, 16
WORD_GAP = r"[^\p{L}\p{N}]+"


def _let(value: Column, body) -> Column:
    """Bind a value once, for use many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def signatures(text: Column, anchors: list[str] = ANCHORS, chain: int = CHAIN) -> Column:
    """The sorted set of a text's signatures, as strings of 12 hex digits; null reads as empty."""
    anchors = sorted(set(anchors))
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_GAP), lambda w: w != "")

    def found(b: Column) -> Column:
        w, at = b["w"], b["at"]
        previous = lambda j: F.when(j == 0, F.lit(-1)).otherwise(F.get(at, j - 1))
        starts = F.filter(F.sequence(F.lit(0), F.size(at) - 1), lambda j: F.get(at, j) - previous(j) > 1)
        one = lambda j: F.concat_ws(" ", F.get(w, F.get(at, j) - 1), *[F.get(w, F.get(at, j + k)) for k in range(chain)])
        spots = F.transform(starts, lambda j: F.substring(F.md5(one(j)), 1, 12))
        whole = F.array(F.substring(F.md5(F.concat_ws(" ", w)), 1, 12))
        spots = F.when(F.size(at) > 0, F.array_sort(F.array_distinct(spots))).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(spots) == 0, whole).otherwise(spots)

    content = lambda w: F.when(F.size(w) > 0, F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: ~F.get(w, i).isin(anchors))).otherwise(F.array().cast("array<int>"))
    return _let(_let(words, lambda w: F.struct(w.alias("w"), content(w).alias("at"))), found)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; one for two empty ones."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(
        _let(both, lambda n: n / (F.size(a) + F.size(b) - n))
    )


def digest(a: Column) -> Column:
    """A set's digest: its size and the MD5 of its members."""
    return F.concat(F.size(a).cast("string"), F.lit("-"), F.md5(F.concat_ws(",", a)))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text, sigs, next_text, next_sigs)``: each document beside the next by ascending id.

    After the last comes the first. Null ids come before all others, rows that share an id are
    ordered by a hash of their text. Documents are dealt to ranges of ids, in each of which a window looks
    ahead; only the first document of each range crosses to the range before it. Rows that share one id lie in one range. Other columns
    play no part; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cuts = sorted(set(own.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))))
    place = F.lit(0)
    if cuts:
        steps = F.array(*[F.lit(int(c)) for c in cuts])
        place = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(steps, lambda c: c < F.col("doc_id"))))
    own = own.withColumns({"range": place, "tie": F.xxhash64("text")})
    order = F.struct(F.col("doc_id").isNotNull().alias("n"), F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("tie").alias("t"))
    firsts = own.groupBy("range").agg(F.min_by("text", order).alias("text"))
    by = Window.orderBy("range")  # the numbers of the ranges meet in one task, the texts don't
    everything = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = own.select("range").distinct().select("range", F.coalesce(F.lead("range").over(by), F.first("range").over(everything)).alias("next"))
    after = steps.join(firsts.select(F.col("range").alias("next"), F.col("text").alias("after")), "next").select("range", "after")
    dealt = own.repartition("range").withColumn("sigs", signatures(F.col("text")))
    within = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "tie")
    ahead = dealt.withColumns({"lead_text": F.lead("text").over(within), "lead_sigs": F.lead("sigs").over(within)})
    met = ahead.join(after, "range")
    return met.select(
        "doc_id", "text", "sigs",
        F.coalesce("lead_text", "after").alias("next_text"),
        F.when(F.col("lead_text").isNotNull(), F.col("lead_sigs")).otherwise(signatures(F.col("after"))).alias("next_sigs"),
    )


def _codes(sigs: Column) -> Column:
    """Signatures as numbers of 48 bits, which take half the room of their digits."""
    return F.transform(sigs, lambda s: F.conv(s, 16, 10).cast("bigint"))


def loads(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> list[int]:
    """How many signatures of all documents fall in each hash bucket; as many numbers as buckets reach the driver, whatever the table's size."""
    codes = F.explode_outer(_codes(signatures(F.col(text))))  # an inner explode makes them twice, to filter empty ones first
    seen = docs.select(codes.alias("code")).groupBy((F.col("code") % buckets).alias("bucket")).agg(F.count("*").alias("n"))
    found = dict(seen.collect())
    return [found.get(i, 0) for i in range(buckets)]


def _ranks(counts: list[int]) -> list[int]:
    """Each bucket's place by its load, in 15 bits."""
    place = {b: i for i, b in enumerate(sorted(range(len(counts)), key=counts.__getitem__))}
    return [(place[b] << 15) // len(counts) for b in range(len(counts))]


def _classes(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Documents' fingerprints with their signatures, and (fingerprint, class_id, copies)."""
    own = docs.select(F.col(key).cast("bigint").alias("doc_id"), signatures(F.col(text)).alias("sigs")).withColumn("fingerprint", F.coalesce(digest(F.col("sigs")), F.lit("")))
    return own, own.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))


def _shared(own: DataFrame, counts: list[int], least: float) -> tuple[DataFrame, DataFrame]:
    """``(sets, shared)``: (fingerprint, codes), codes in an order that is the same for all sets, and the signatures of their prefixes that several sets have.

    A prefix is the signatures of the emptiest buckets, as many as one of them must be shared with every set
    in reach. Any order keeps all pairs; this one keeps common signatures out of the prefixes. Signatures in one prefix only go, and of the rest
    sets without another in reach of their length. ``meets`` has the length bands where a set meets others: its own and, as a visitor, the band below.
    Sets are read from one shuffle: an outer explode, a filter behind the sum and a fingerprint
    that can't be null keep filters out of the one side that would part them, and out of the scan, where signatures would be made twice.
    """
    size = F.size("codes")
    sets = own.select("fingerprint", _codes(F.col("sigs")).alias("codes")).groupBy("fingerprint").agg(F.first("codes").alias("codes")).filter(size >= F.lit(least / (1 - least) - 1e-9))
    crowd = F.split(F.lit(",".join(map(str, _ranks(counts)))), ",").cast("array<bigint>")
    ordered = F.sort_array(F.transform("codes", lambda c: F.get(crowd, (c % BUCKETS).cast("int")) * F.lit(1 << 48) + c))  # bucket's rank, then code, in one number
    sets = sets.select("fingerprint", ordered.alias("codes"))
    prefix = F.slice("codes", F.lit(1), size - F.ceil(size * F.lit(least) - 1e-9).cast("int") + 1)
    led = sets.select("fingerprint", size.alias("n"), F.posexplode_outer(prefix).alias("at", "sig"))
    band = F.floor(F.log("n") / F.lit(-math.log(least)) + 1e-9).cast("int")
    by, row = Window.partitionBy("sig"), Window.partitionBy("sig").orderBy("n")
    shared = led.select("fingerprint", "sig", "n", (F.col("n") - F.col("at")).alias("left"), band.alias("band")).withColumns({
        "below": F.lag("n").over(row), "above": F.lead("n").over(row), "sets": F.count("*").over(by),
        "load": F.sum(F.greatest(F.lit(1.0), F.col("n") / WHOLE)).over(by), "bands": F.collect_set("band").over(by),
    })
    shared = shared.filter((F.col("below") >= F.col("n") * F.lit(least) - 1e-9) | (F.col("n") >= F.col("above") * F.lit(least) - 1e-9))
    meets = F.when(F.array_contains("bands", F.col("band") - 1), F.array(F.col("band"), F.col("band") - 1)).otherwise(F.array("band"))
    return sets, shared.select("fingerprint", "sig", "n", "left", "band", "sets", "load", meets.alias("meets"))


def _may(x: Column, y: Column, least: float) -> Column:
    """Whether lengths, and places in the prefixes, leave two members of a band enough common signatures; one of them is at home there."""
    near = F.least(x["n"], y["n"]) >= F.greatest(x["n"], y["n"]) * F.lit(least) - 1e-9
    return (x["own"] | y["own"]) & near & (F.least(x["left"], y["left"]) >= (x["n"] + y["n"]) * F.lit(least / (1 + least)) - 1e-9)


def _larger(x: Column, y: Column) -> Column:
    return (y["n"] < x["n"]) | ((y["n"] == x["n"]) & (y["fingerprint"] < x["fingerprint"]))


def _told(x: Column, y: Column, sig: Column, least: float) -> Column:
    """The similarity of two sets of codes, if it is ``least`` or more and ``sig`` is their first common signature; else null. The first lies in both prefixes of any pair in reach."""
    score = lambda c: F.when(F.get(c, F.lit(0)) == sig, F.size(c).cast("double") / (F.size(x) + F.size(y) - F.size(c)))
    return _let(_let(F.array_intersect(x, y), score), lambda v: F.when(v >= least, v))


def _rare(sets: DataFrame, shared: DataFrame, least: float) -> DataFrame:
    """(a, b, score) of the pairs whose first common signature is one of ``FEW`` sets or less: a row for each pair, at most ``FEW`` for each signature of a set."""
    at = F.explode("meets").alias("at")
    some = shared.filter(F.col("sets") <= FEW).select("sig", "fingerprint", "n", "left", "band", at)
    groups = some.groupBy("sig", "at").agg(F.collect_list(F.struct("fingerprint", "n", "left", (F.col("at") == F.col("band")).alias("own"))).alias("members"))
    x = F.col("x")
    smaller = F.filter("members", lambda y: _larger(x, y) & _may(x, y, least))
    met = groups.select("sig", "members", F.explode("members").alias("x")).select("sig", x["fingerprint"].alias("a"), F.explode(F.transform(smaller, lambda y: y["fingerprint"])).alias("b"))
    pairs = met.groupBy("a", "b").agg(F.min("sig").alias("sig"))
    of = lambda c: sets.select(F.col("fingerprint").alias(c), F.col("codes").alias(f"codes_{c}"))
    scored = pairs.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b")
    return scored.select("a", "b", _told(F.col("codes_a"), F.col("codes_b"), F.col("sig"), least).alias("score")).filter("score IS NOT NULL")


def _blocks(sets: DataFrame, shared: DataFrame, piece: int) -> DataFrame:
    """``(sig, band, low, high, members)``: the sets of each signature of more than ``FEW``, whole, by band.

    A signature with over ``piece`` sets (a long one counts more) is cut into parts of half that size, and each two of them, and each with itself, make a block.
    """
    parts = F.when(F.col("load") > piece, F.ceil(2 * F.col("load") / piece)).otherwise(1).cast("int")
    some = shared.filter(F.col("sets") > FEW).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int"))
    member = F.struct("fingerprint", "n", "left", "part", "codes", (F.col("meets.at") == F.col("band")).alias("own"))
    places = F.flatten(F.transform("meets", lambda at: F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(at.alias("at"), F.least("part", i).alias("low"), F.greatest("part", i).alias("high")))))
    dealt = some.join(sets.hint("merge"), "fingerprint").withColumn("meets", F.explode(places)).select("sig", "meets.*", member.alias("member"))
    return dealt.groupBy("sig", F.col("at").alias("band"), "low", "high").agg(F.collect_list("member").alias("members"))


def _score(x: Column, y: Column, least: float) -> Column:
    """The similarity of two members of a block, if this block is the one that tells it; pairs of one part are told in that part's own block."""
    apart = ((F.col("low") == F.col("high")) | (x["part"] != y["part"])) & (x["fingerprint"] != y["fingerprint"])
    return F.when(apart & _may(x, y, least), _told(x["codes"], y["codes"], F.col("sig"), least))


def similar(docs: DataFrame, least: float = LINKED, key: str = "doc_id", text: str = "text", piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """``(classes, pairs)``: (fingerprint, class_id, copies) of all sets, and (a, b, score) of different sets of similarity ``least`` (below 1) or more.

    A class is all documents of one set, named by its least id (null if it has only null ids); sets take part once, however many copies they
    have. a and b are fingerprints, and a is the larger set. The empty set pairs with nothing, nor do sets so small that one signature more or less parts them.

    Sets are dealt by the signatures of their prefixes and by length bands (``_shared``). A pair is told by its first common signature alone: if few
    sets have it, the pair is a row that meets its two sets, else it is told within a block of whole sets.
    Here each pair is a row, so rows grow with the square of a family of near copies; ``with_links`` counts them without.
    """
    own, classes = _classes(docs, key, text)
    sets, shared = _shared(own, loads(docs, text), least)
    x = F.col("x")
    near = F.transform(F.filter("members", lambda y: _larger(x, y)), lambda y: F.struct(y["fingerprint"].alias("b"), _score(x, y, least).alias("score")))
    rows = _blocks(sets, shared, piece).select("*", F.explode("members").alias("x"))
    return classes, _rare(sets, shared, least).unionByName(rows.select(x["fingerprint"].alias("a"), F.inline(F.filter(near, lambda p: p["score"].isNotNull()))))


def with_links(docs: DataFrame, least: float = LINKED, key: str = "doc_id", text: str = "text", classes: DataFrame | None = None, piece: int = PIECE) -> DataFrame:
    """(fingerprint, class_id, copies, links): ``similar``'s classes (or those given, where they are known) with the number of other classes each is linked to, as a written table.

    Blocks count their members' links in place and give a row for each member, so no rows are made for the pairs of a large family.
    """
    own, told = _classes(docs, key, text)
    classes = told if classes is None else classes
    sets, shared = _shared(own, loads(docs, text), least)
    near = lambda x: F.size(F.filter("members", lambda y: _score(x, y, least).isNotNull())).cast("bigint")
    counted = F.transform("members", lambda x: F.struct(x["fingerprint"].alias("fingerprint"), near(x).alias("links")))
    rare = _rare(sets, shared, least).select(F.explode(F.array("a", "b")).alias("fingerprint"), F.lit(1).cast("bigint").alias("links"))
    links = rare.unionByName(_blocks(sets, shared, piece).select(F.inline(counted))).groupBy("fingerprint").agg(F.sum("links").alias("links")).filter("links > 0")
    return stored(classes.join(links.hint("merge"), "fingerprint", "left").withColumn("links", F.coalesce("links", F.lit(0).cast("bigint"))), "classes")


def _beside(rows: DataFrame, classes: DataFrame, spread: str, most: int = 1024) -> DataFrame:
    """``rows`` with class_id and links; the ``most`` classes of most copies are sent to all tasks, so no hot class meets in one."""
    told = classes.select("fingerprint", F.struct("class_id", "links").alias("told"), "copies")
    hot = F.broadcast(told.orderBy(F.desc("copies"), "fingerprint").limit(most).select("fingerprint", F.col("told").alias("hot")))
    met = rows.join(hot, "fingerprint", "left").withColumn("at", F.when(F.col("hot").isNull(), F.col("fingerprint")).otherwise(F.concat(F.lit("hot"), spread)))
    met = met.join(told.select(F.col("fingerprint").alias("at"), "told"), "at", "left").withColumn("told", F.coalesce("hot", "told"))
    return met.select(*rows.columns, "told.class_id", "told.links")


def op7(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with the likeness to these and to the next document, and each document's class and its links.

    A class is the documents of equal fingerprint; links counts the other classes at a similarity of 0.8 or more (``similar``). Nulls and repeated ids as ``with_next`` states; texts are whole, and a row takes a few times the size of its text. Texts without words have the empty set.
    """
    docs = table(spark, sf_dir, "documents")
    met = with_next(docs)
    n = F.length("text")
    k = (n / 4).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - int(length(text) / 4))"), F.expr("left(next_text, int(length(text) / 4))"))
    out = met.withColumns({"n": n, "k": k, "edited": edited}).withColumn("edited_sigs", signatures(F.col("edited")))
    rows = out.select(
        "doc_id", F.col("n").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        digest(F.col("sigs")).alias("fingerprint"), digest(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )
    rows = stored(rows, "spots")
    classes = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    return _beside(rows, with_links(docs, classes=classes), "edited_sha256")


def _sql_sigs(text: str) -> str:
    anchors = ", ".join(f"'{w}'" for w in sorted(set(ANCHORS)))
    words = f"list_filter(regexp_split_to_array(lower({text}), '{WORD_GAP}'), lambda x: x <> '')"
    return f"""(SELECT CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(s) = 0 THEN [left(md5(array_to_string(w, ' ')), 12)] ELSE list_sort(list_distinct(s)) END
      FROM (SELECT w, list_transform(list_filter(range(1, len(c) + 1), lambda j: c[j] - coalesce(CASE WHEN j > 1 THEN c[j - 1] END, 0) > 1),
          lambda j: left(md5(array_to_string(list_concat([w[c[j] - 1]], list_transform(c[j:j + {CHAIN - 1}], lambda p: w[p])), ' ')), 12)) AS s
        FROM (SELECT w, list_filter(range(1, len(w) + 1), lambda i: w[i] NOT IN ({anchors})) AS c FROM (SELECT {words} AS w))))"""


_NEAR = "CASE WHEN len({0}) = 0 AND len({1}) = 0 THEN 1.0 WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1}))::DOUBLE / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) END"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_text FROM d),
e AS (SELECT *, left(text, length(text) - length(text) // 4) || left(next_text, length(text) // 4) AS edited FROM n),
s AS (SELECT *, {_sql_sigs("text")} AS a, {_sql_sigs("edited")} AS b, {_sql_sigs("next_text")} AS c FROM e),
k AS (SELECT a, min(doc_id) AS class_id FROM s GROUP BY a),
u AS (SELECT class_id, len(a) AS n, unnest(a) AS sig FROM k),
j AS (SELECT x.class_id, x.n AS m, y.n, count(*) AS common FROM u x JOIN u y ON x.sig = y.sig AND x.class_id <> y.class_id GROUP BY x.class_id, y.class_id, x.n, y.n),
l AS (SELECT class_id, count(*) AS links FROM j WHERE common::DOUBLE / (m + n - common) >= {LINKED} GROUP BY class_id)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256,
  len(a)::VARCHAR || '-' || md5(array_to_string(a, ',')) AS fingerprint, len(b)::VARCHAR || '-' || md5(array_to_string(b, ',')) AS edited_fingerprint,
  CAST({_NEAR.format("a", "b")} AS DOUBLE) AS near_edited, CAST({_NEAR.format("a", "c")} AS DOUBLE) AS near_next,
  class_id, coalesce(links, 0) AS links
FROM s JOIN k USING (a) LEFT JOIN l USING (class_id)"""
