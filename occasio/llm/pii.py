"""Personal data in texts: base patterns, and identifiers found through the contexts that base entities occur in.

Everything here is DataFrame and SQL functions.

The base patterns are written so that a match never backs off: a run of one class is taken whole, and a match may
begin only where such a run begins or where the match before ended. Both give the same matches as the plain
patterns and keep the time linear in the text's length.

Bootstrapping (Riloff and Jones, 1999; Agichtein and Gravano, 2000): an instance is a word with a digit or an @ in it, or
numbers in a row, without quotes and marks around it; its contexts, the patterns, are the word before it and the two words before it
(``key="x1"`` has the context ``key=``). Seeds are the instances that are base matches, and long random strings of the
shape of keys (``SECRET``), which count as instances of a kind of their own but make no span by themselves. Patterns and
instances form a graph over the whole corpus. Each round scores a pattern by the share of all its occurrences, those
without an instance after them too, that known instances follow, weighed by what is known of them, and an instance by the
trusted patterns that hold it (noisy or); trusted patterns so make further instances known, and these support further
patterns, until a round finds no pattern to trust. Copies of one text give one instance, so they are no support.
Instances after a trusted pattern that no base match touches are added as spans of the pattern's kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import drop, materialize, table

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
ADDED = (*KINDS, "secret")
_IP_OK = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
SECRET = r"^(?=.*[0-9])(?=.*[A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|[A-Za-z0-9+/_-]{40,})$"
#: Numbers in a row, one space apart; or a word with a digit or @ in it.
CANDIDATE = r"(?<!\S)(?:[+(]*+[0-9][0-9().+-]*+(?: [(]?+[0-9][0-9().-]*+)*+(?=[\s,;:!?\"'>\]]|$)|[^\s0-9@]*+[0-9@]\S*+)"
#: Its head: marks, and a name that ends with = or : and marks.
_HEAD = r"^[^0-9A-Za-z+@]*+(?:[A-Za-z][A-Za-z_.-]*+[=:][^0-9A-Za-z+@]*+)?+"
_NAME = r"[A-Za-z][A-Za-z_.-]*+[=:]"
_LAST = r"(?<!\S)(\S++)\s*+$"
_LAST_BUT_ONE = r"(?<!\S)(\S++)\s++\S++\s*+$"
MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.5
CHUNK = 64


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether Luhn's sum of a digit string is a multiple of ten."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise((d.try_cast("int") * 2) % 10 + F.floor(d.try_cast("int") / 5).cast("int")))
    return F.aggregate(F.filter(each, lambda v: v.isNotNull()), F.lit(0), lambda a, v: a + v) % 10 == 0


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def _matches(text: Column, pattern: str, may: Column, kind: str = "struct<s:int,e:int,v:string>", of=lambda s, e, pair: F.struct(s.alias("s"), e.alias("e"), pair["v"].alias("v"))) -> Column:
    """``of`` (start, end, (gap before, value)) for each match, in code points. ``may``: whether the text can hold one.

    Places are summed up within chunks of ``CHUNK`` matches, from the sums of the chunks before, so that the arrays that
    grow match by match stay short: time goes with the matches, not with their square.
    """
    none = F.expr(f"cast(array() as array<{kind}>)")
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    pairs = F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("v")), lambda p: F.struct(p["gap"].alias("gap"), p["v"].alias("v")))
    size = lambda pair: F.length(pair["gap"]) + F.coalesce(F.length(pair["v"]), F.lit(0))

    def chunk_start(acc: Column, chunk: Column) -> Column:
        upto = acc["at"] + F.aggregate(chunk, F.lit(0), lambda n, pair: n + size(pair))
        return F.struct(upto.alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        s = acc["at"] + F.length(pair["gap"])
        e = s + F.length(pair["v"])
        return F.struct(e.alias("at"), F.when(pair["v"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(of(s, e, pair)))).alias("out"))

    def placed(chunks: Column) -> Column:
        starts = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")), chunk_start, lambda acc: acc["out"])
        return F.flatten(F.zip_with(chunks, starts, lambda chunk, at: F.aggregate(chunk, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])))

    def cut(all_pairs: Column) -> Column:
        last = F.floor((F.size(all_pairs) - 1) / CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(all_pairs, c * CHUNK + 1, F.lit(CHUNK)))

    return F.when(may, _let(_let(pairs, cut), placed)).otherwise(none)


def _base(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), and for each kind the array of its valid matches."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    digit = F.col("text").rlike("[0-9]")
    d = d.select("*", F.col("text").contains("@").alias("_at"), digit.alias("_digit"))
    t = F.col("text")
    return d.select(
        "doc_id",
        "text",
        "_digit",
        "_at",
        _matches(t, EMAIL, F.col("_at")).alias("email"),
        F.filter(_matches(t, IP, F.col("_digit") & t.rlike(r"[0-9]\.[0-9]")), lambda m: m["v"].rlike(_IP_OK)).alias("ip"),
        F.filter(_matches(t, CARD, F.col("_digit") & t.rlike(r"[0-9](?:[ -]?[0-9]){15}")), lambda m: _is_card(m["v"])).alias("card"),
        F.filter(_matches(t, PHONE, F.col("_digit") & t.contains("+")), lambda m: F.length(_digits(m["v"])).between(8, 15)).alias("phone"),
    )


def _is_card(v: Column) -> Column:
    return F.length(_digits(v)).between(16, 19) & _luhn(_digits(v))


def _clean(word: Column) -> Column:
    """A word as patterns have it: lower case, all digits alike; null if there is none."""
    return F.when(word != "", F.regexp_replace(F.lower(word), "[0-9]", "0"))


def _key(*words: Column) -> Column:
    """The number of a pattern; null if a word is missing."""
    key = F.xxhash64(F.lit(len(words)), *words)
    for w in words:
        key = F.when(w.isNotNull(), key)
    return key


_CANDIDATES = "struct<s:int,e:int,inst:bigint,p1:bigint,p2:bigint,context:string,kind:string,free:boolean>"


def _candidate(s: Column, e: Column, pair: Column) -> Column:
    """An instance with its contexts: the two patterns' numbers, and their words."""
    v = pair["v"]
    head = F.regexp_extract(v, _HEAD, 0)
    body = lambda h: F.regexp_replace(F.substr(v, F.length(h) + 1), "(?<![^0-9A-Za-z])[^0-9A-Za-z]++$", "")
    return _let(head, lambda h: _let(body(h), lambda x: _instance(s + F.length(h), x, h, pair)))


def _instance(begin: Column, body: Column, head: Column, pair: Column) -> Column:
    name = _clean(F.regexp_extract(head, _NAME, 0))
    one, two = _clean(F.regexp_extract(pair["gap"], _LAST, 1)), _clean(F.regexp_extract(pair["gap"], _LAST_BUT_ONE, 1))
    digits = F.length(_digits(body))
    ip, card = body.rlike(r"[0-9]\.[0-9]"), digits >= 16
    kind = (
        F.when(body.contains("@") & body.rlike(f"^{EMAIL}$"), "email")
        .when(ip & body.rlike(f"^{IP}$") & body.rlike(_IP_OK), "ip")
        .when(card & body.rlike(f"^{CARD}$") & _is_card(body), "card")
        .when(body.startswith("+") & body.rlike(f"^{PHONE}$") & digits.between(8, 15), "phone")
        .when((F.length(body) >= 32) & body.rlike(SECRET), "secret")
        .otherwise("")
    )
    touched = body.contains("@") & body.rlike(EMAIL) | ip & F.exists(F.regexp_extract_all(body, F.lit(IP), 0), lambda m: m.rlike(_IP_OK)) | body.contains("+") & body.rlike(PHONE)
    touched = touched | card & F.exists(F.regexp_extract_all(body, F.lit(CARD), 0), _is_card)

    def contexts(w: Column) -> Column:
        last, before = w["last"], w["before"]
        return F.struct(
            begin.alias("s"), (begin + F.length(body)).alias("e"), F.xxhash64(F.lower(body)).alias("inst"), _key(last).alias("p1"), _key(before, last).alias("p2"),
            F.concat_ws(" ", before, last).alias("context"), kind.alias("kind"), (~touched & (F.length(body) > 0)).alias("free"),
        )

    words = _let(F.struct(name.alias("n"), one.alias("one"), two.alias("two")), lambda w: F.struct(F.coalesce(w["n"], w["one"]).alias("last"), F.when(w["n"].isNull(), w["two"]).otherwise(w["one"]).alias("before")))
    return _let(words, contexts)


def entities(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """doc, fp, the base spans of each kind and the candidates of every row, in the shared folder; and the table."""
    d = _base(docs)
    found = _matches(F.col("text"), CANDIDATE, F.col("_digit") | F.col("_at"), _CANDIDATES, _candidate)
    spans = [F.transform(k, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"))).alias(k) for k in KINDS]
    # A card or phone number with spaces may reach over several candidates.
    wide = F.concat(*[F.transform(F.filter(k, lambda m: m["v"].contains(" ")), lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"))) for k in ("card", "phone")])
    d, path = materialize(d.select("doc_id", F.xxhash64("text").alias("fp"), *spans, wide.alias("wide"), found.alias("found")), "pii-entities")
    return d, [path]


def _named(kind: str, arr: Column) -> Column:
    return F.transform(arr, lambda m: F.concat_ws(":", F.lit(kind), m["s"].cast("string"), m["e"].cast("string")))


def learn_patterns(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, list[str]]:
    """Trusted patterns (p, kind, confidence, context), and their table. ``found``: the :func:`entities` of ``docs``.

    A pattern is trusted with MIN_SUPPORT different known instances and a confidence of MIN_CONFIDENCE. A word like an
    article, which now and then precedes a number, never has that. Null and empty texts hold no instance. The graph,
    patterns and totals are tables; nothing but the number of trusted patterns comes to the driver.
    """
    spark = docs.sparkSession
    rows = found.select(F.explode("found").alias("x")).select("x.*")
    words = F.split("context", " ")
    edges = rows.select("inst", "kind", F.explode(F.array(F.struct(F.col("p1").alias("p"), F.element_at(words, -1).alias("context")), F.struct(F.col("p2").alias("p"), F.col("context")))).alias("y"))
    graph = edges.where("y.p is not null").groupBy("y.p", "inst").agg(F.max("kind").alias("kind"), F.count("*").alias("n"), F.min("y.context").alias("context"))
    graph, graph_path = materialize(graph, "pii-graph")
    wanted = graph.groupBy("p").agg(F.count("*").alias("instances"), F.min("context").alias("context")).where(F.col("instances") >= MIN_SUPPORT)
    wanted, wanted_path = materialize(wanted.select("p", _key(F.element_at(F.split("context", " "), -1)).alias("last")), "pii-patterns")
    pairs = _let(
        F.split(F.regexp_replace(F.lower(F.col("text").cast("string")), "[0-9]", "0"), r"[\x20\x09-\x0D]+"),
        lambda w: F.transform(w, lambda x, i: F.struct(_key(x).alias("one"), _key(F.when(i > 0, F.get(w, i - 1)), x).alias("two"))),
    )
    heads = wanted.select(F.col("last").alias("one")).distinct()
    seen = docs.select(F.explode(pairs).alias("x")).select("x.*").join(heads, "one", "left_semi")
    seen = seen.join(wanted.select(F.col("p").alias("two"), F.lit(True).alias("counts")), "two", "left")
    seen = seen.groupBy("one", F.when(F.col("counts"), F.col("two")).alias("two")).agg(F.count("*").alias("n"))
    seen, seen_path = materialize(seen, "pii-occurrences")
    total = seen.groupBy(F.col("one").alias("p")).agg(F.sum("n").alias("total")).union(seen.where("two is not null").groupBy("two").agg(F.sum("n")))
    edges = graph.join(wanted.select("p"), "p").join(total, "p", "left")
    edges, edges_path = materialize(edges.select("p", "inst", "n", F.coalesce("total", F.lit(0)).alias("total"), "context"), "pii-edges")
    first = graph.groupBy("inst").agg(F.max("kind").alias("kind"))
    known, known_path = materialize(first.select("inst", F.when(F.col("kind") != "", 1.0).otherwise(0.0).alias("score"), "kind"), "pii-instances")
    drop(spark, wanted_path, seen_path, graph_path)
    before, patterns_path = -1, None
    while True:
        weight = F.col("n") * F.col("score")
        patterns = edges.join(known, "inst").groupBy("p").agg(
            (F.sum(weight) / F.greatest(F.max("total"), F.sum("n"))).alias("confidence"), F.count(F.when(F.col("score") >= MIN_CONFIDENCE, 1)).alias("support"), F.max_by("kind", F.struct(weight, "kind")).alias("kind"), F.min("context").alias("context")
        )
        patterns = patterns.where((F.col("support") >= MIN_SUPPORT) & (F.col("confidence") >= MIN_CONFIDENCE) & (F.col("kind") != "")).drop("support")
        patterns, now_path = materialize(patterns, "pii-trusted")
        drop(spark, *([patterns_path] if patterns_path else []))
        patterns_path, now = now_path, patterns.count()
        if now <= before or not now:
            drop(spark, edges_path, known_path)
            return patterns, [patterns_path]
        before = now
        held = edges.select("p", "inst").join(patterns.select("p", "confidence", F.col("kind").alias("via")), "p")
        held = held.groupBy("inst").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("by_patterns"), F.max_by("via", F.struct("confidence", "via")).alias("via"))
        more = known.join(held, "inst", "left").select("inst", F.greatest("score", F.coalesce("by_patterns", F.lit(0.0))).alias("score"), F.when(F.col("kind") != "", F.col("kind")).otherwise(F.coalesce("via", F.lit(""))).alias("kind"))
        more, more_path = materialize(more, "pii-instances")
        drop(spark, known_path)
        known, known_path = more, more_path


def find_spans(found: DataFrame, patterns: DataFrame | None) -> DataFrame:
    """Base spans and those that trusted patterns add: ``doc_id``, counts, ``base_sha256``, ``spans``, ``n_spans``,
    ``n_found``. ``found``: :func:`entities`.

    An added span has its best pattern's kind and touches no base span. A null text counts as empty; every row gives one
    row, in any order, whatever its doc_id, repeated rows too.
    """
    base = F.array_join(F.concat(*[_named(k, F.col(k)) for k in KINDS]), ",")
    none = F.expr("cast(array() as array<struct<k:string,s:int,e:int>>)")
    rows = found.withColumn("doc", F.coalesce("doc_id", F.lit(-(2**63))))
    if patterns is None:
        rows = rows.withColumn("more", none)
    else:
        hits = rows.select("doc", "fp", "wide", F.explode(F.filter("found", lambda x: x["free"])).alias("x")).select("doc", "fp", "wide", "x.s", "x.e", F.explode(F.array("x.p1", "x.p2")).alias("p"))
        hits = hits.join(patterns.select("p", "kind", "confidence"), "p").where(~F.exists("wide", lambda b: (b["s"] < F.col("e")) & (F.col("s") < b["e"])))
        hits = hits.groupBy("doc", "fp", "s", "e").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("k"))
        hits = hits.groupBy("doc", "fp").agg(F.collect_list(F.struct("k", "s", "e")).alias("more"))
        rows = rows.join(hits, ["doc", "fp"], "left").withColumn("more", F.coalesce("more", none))

    def both(k: str) -> Column:
        extra = F.transform(F.filter("more", lambda x: x["k"] == k), lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e")))
        return _named(k, F.array_sort(F.concat(F.col(k), extra)) if k in KINDS else F.array_sort(extra))

    spans = F.array_join(F.concat(*[both(k) for k in ADDED]), ",")
    sizes = [F.size(k).cast("long") for k in KINDS]
    n_found = F.size("more").cast("long")
    return rows.select("doc_id", *[n.alias(f"n_{k}") for n, k in zip(sizes, KINDS)], F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"), (sum(sizes[1:], sizes[0]) + n_found).alias("n_spans"), n_found.alias("n_found"))


def pii(docs: DataFrame) -> DataFrame:
    """Learn the corpus's own patterns, then find all spans. See :func:`learn_patterns`, :func:`find_spans`."""
    found, _ = entities(docs)
    patterns, _ = learn_patterns(docs, found)
    return find_spans(found, patterns)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(table(spark, sf_dir, "documents"))
