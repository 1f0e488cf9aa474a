"""Benchmark decontamination by template canonicalisation, with DataFrame functions alone.

Numbers, names and units become typed placeholders, so that a question asked anew with other values keeps its template.
Windows of five template tokens are hashed and joined with the benchmark's; a document with a passage that holds at least
0.8 of an item's windows, and whose values stand consistently in the item's slots, is contaminated. A text has two
templates: `plain`, whose names stay words, so that a copy is found whatever its capitals; and `named`, whose capitalised
words are placeholders wherever they stand, so that what precedes a word makes no difference. Either may be met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, small_side

WIDTH, COVERAGE, CONSISTENCY = 5, 0.8, 0.8
#: Words by which the parts of one copy may be moved against each other, at most half of this for certain.
DRIFT = 16
#: A passage is looked at in cells of so many times the item's length, every half of it, so one of twice its length is whole.
CELL = 4
UNITS = (
    "km|cm|mm|m|kg|mg|g|lb|lbs|oz|ft|in|inch|inches|feet|mile|miles|yard|yards|meter|meters|metre|metres|kilometers|liter|liters|litre|litres|ml|l"
    "|second|seconds|sec|minute|minutes|min|hour|hours|hr|hrs|day|days|week|weeks|month|months|year|years"
    "|percent|dollar|dollars|usd|cent|cents|euro|euros|eur|pound|pounds|degree|degrees|mph|kph|hz|khz|mhz|ghz|kb|mb|gb|tb|watt|watts|volt|volts"
)
#: First words of items' windows by which texts are read first, if there are no more of them; they are in the plan.
ANCHORS = 5000
NAME = r"(?<!\p{L})\p{Lu}\p{L}*"


def marked(texts: DataFrame, *keys) -> DataFrame:
    """keys and `m`: a text's lower-cased words parted by single spaces; values carry their type in front: #n number, #p
    name (any capitalised word), #u unit after a number. Texts without a digit skip what is about numbers."""
    low = F.lower(F.regexp_replace(F.replace(F.col("text"), F.lit("#"), F.lit(" ")), NAME, "#p$0"))
    t = F.regexp_replace("#t", r"(\d)[.,](?=\d)", "$1")
    t = F.regexp_replace(t, r"\d+", " #n$0 ")
    t = F.regexp_replace(t, rf"(#n\d+)\s+(?:#p)?({UNITS})(?!\p{{L}})", "$1 #u$2")
    t = F.regexp_replace(t, r"(#n\d+)\s*([%€$£°])", "$1 #u_$2 ")
    t = F.when(F.col("#t").rlike("[0-9]"), t).otherwise(F.col("#t"))
    kept = texts.select(*keys, low.alias("#t"))
    return kept.select(*kept.columns[:-1], F.trim(F.regexp_replace(t, r"[^\p{L}\p{Nd}#]+", " ")).alias("m"))


def words(text: Column, form: str) -> Column:
    """Tokens of a marked text: `valued` (names are words, numbers and units carry their values) and its template `plain`;
    `named` (names carry theirs too, neighbouring ones join) and its template `slots`."""
    if form in ("valued", "plain"):
        t = F.replace(text, F.lit("#p"), F.lit(""))
        return F.split(t if form == "valued" else F.when(text.contains("#n"), F.regexp_replace(t, "#([nu])[^ ]*", "#$1")).otherwise(t), " ")
    t = F.regexp_replace(text, r"(#p\p{L}*) (?=#p)", "$1")
    return F.split(t if form == "named" else F.regexp_replace(t, "#([pnu])[^ ]*", "#$1"), " ")


def windows(tokens: Column, width, kind: str, make, firsts: list[str] | None = None) -> Column:
    """make(place, hash) of every run of `width` tokens, or of those that begin with one of firsts."""
    one = lambda i: make(i, F.xxhash64(F.lit(kind), F.slice(tokens, i + 1, width)))
    places = F.sequence(F.lit(0), F.size(tokens) - width)
    if firsts is not None:
        places = F.filter(places, lambda i: F.get(tokens, i).isin(firsts))
    return F.when(F.size(tokens) >= width, F.transform(places, one)).otherwise(F.array())


def item_marks(items: DataFrame) -> DataFrame:
    """item_id, item_text, kind, length, windows, hash, item_at, word: what a document must hold of each item. word is a
    window's first token.

    kind `plain` or `slots`: windows of a template with two words or more that are no placeholders. An item without such
    a window is looked for with its values, by windows of five tokens or, if it is shorter, whole (`valued`); one of one or
    two tokens only as a text of its own (`alone`).
    """
    read = marked(items, "item_id", F.xxhash64("text").alias("item_text")).where("m <> ''").distinct()
    cut = read.select("item_id", "item_text", *[words(F.col("m"), f).alias(f) for f in ("plain", "slots", "valued")])
    n = F.size("plain")
    place = lambda form: lambda i, h: F.struct(i.alias("at"), h.alias("hash"), F.get(form, i).alias("word"))

    def dense(form: str) -> Column:
        words_in = lambda w: F.size(F.filter(F.slice(F.col(form), w["at"] + 1, WIDTH), lambda t: ~t.startswith("#"))) >= 2
        return F.filter(windows(F.col(form), F.lit(WIDTH), form, place(form)), words_in)

    found = cut.select("item_id", "item_text", "valued", n.alias("length"), dense("plain").alias("plain"), F.when(F.exists("slots", lambda t: t == "#p"), dense("slots")).alias("slots"))
    whole = F.array(place("valued")(F.lit(0), F.xxhash64(F.lit("alone"), F.col("valued"))))
    length = F.col("length")
    valued = F.when((length > 2) & (F.size("plain") == 0), windows(F.col("valued"), F.least(length, F.lit(WIDTH)), "valued", place("valued")))
    kinds = {"plain": F.col("plain"), "slots": F.col("slots"), "valued": valued, "alone": F.when(length <= 2, whole)}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(v, F.array()).alias("marks")) for k, v in kinds.items()]))
    marks = found.select("item_id", "item_text", "length", each.alias("of")).select(
        "item_id", "item_text", "length", "of.kind", F.size(F.array_distinct(F.transform("of.marks", lambda w: w["hash"]))).alias("windows"), F.explode("of.marks").alias("w")
    )
    return marks.select("item_id", "item_text", "kind", "length", "windows", F.col("w.hash").alias("hash"), F.col("w.at").alias("item_at"), F.col("w.word").alias("word"))


def telling(first: DataFrame) -> DataFrame:
    """Of first(item_id, item_text, kind, windows, hash, word), a row a window, as many windows of each item as leave too few
    others to cover it: whatever holds the item holds one of them. Those that begin with long words, which are rare."""
    least = F.ceil(COVERAGE * F.col("windows") - 1e-6)
    rare = Window.partitionBy("item_id", "item_text", "kind").orderBy(F.col("word").startswith("#"), F.length("word").desc(), "word", "hash")
    return first.withColumn("rank", F.row_number().over(rare)).where(F.col("rank") <= F.col("windows") - least + 1)


def document_marks(texts: DataFrame, keys: list[str], asked: dict[str, list[int]], make, firsts: dict[str, list[str]] | None = None) -> DataFrame:
    """keys and `w`, make(place, hash) of every window of texts(keys, text) of the kinds and widths that are asked for, or
    of those that begin with one of their kind's firsts."""
    forms = [f for f in ("plain", "slots", "valued") if f in asked or (f == "valued" and "alone" in asked)]
    cut = marked(texts, *keys).select(*keys, *[words(F.col("m"), f).alias(f) for f in forms])
    found = [windows(F.col(k), F.lit(w), k, make, None if firsts is None else firsts.get(k, [])) for k in forms for w in asked.get(k, [])]
    if "alone" in asked:
        found.append(F.when(F.size("valued") <= 2, F.array(make(F.lit(0), F.xxhash64(F.lit("alone"), F.col("valued"))))).otherwise(F.array()))
    return cut.select(*keys, F.explode(F.concat(*found)).alias("w"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched, windows, coverage, slots, consistency, kind: a row for each document and item it holds.

    Whole texts of docs(doc_id, text) against benchmark(item_id, text), whatever their length. consistency is the share of
    the item's slot values that meet one document value throughout a passage; kind is `copy` if each meets itself (or
    there are none), else `reparameterised`. Items whose templates say too little are found as copies only: those without a
    window of two words, and those of fewer than five tokens; items of one or two tokens only where they are a document's
    whole text. Null, empty and wordless texts and items hold and are nothing; null ids match nothing; rows that share a
    doc_id or an item_id are judged text by text, equal ones once. Every place of every window counts: a passage is what
    stands at one alignment (place in the document less place in the item), at alignments up to DRIFT apart, or within a
    cell of CELL times the item's length, where a window's first place is taken. A row stands for the best passage that
    passes, in either template: copies first, then by windows, consistency and slots. Other columns are ignored. Empty tables give an
    empty result.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    docs, items = docs.select("doc_id", "text").where("doc_id is not null"), benchmark.select("item_id", "text").where("item_id is not null")
    parts = scratch.save("items", item_marks(items))
    asked: dict[str, list[int]] = {}
    for r in parts.select("kind", F.when(F.col("kind") == "valued", F.least("length", F.lit(WIDTH))).otherwise(WIDTH).alias("width")).distinct().collect():
        asked.setdefault(r.kind, []).append(r.width)
    of = ["item_id", "item_text", "kind"]
    asked = asked or {"plain": [WIDTH]}
    first = parts.groupBy("hash", *of).agg(F.first("windows").alias("windows"), F.first("word").alias("word"))

    # documents that hold a telling window of an item, the only ones that can hold the item
    told = scratch.save("told", telling(first).select("kind", "hash", "word").distinct())
    few = told.where("kind <> 'alone'").select("kind", "word").distinct().limit(ANCHORS + 1).collect()
    firsts: dict[str, list[str]] = {}
    for r in few:
        firsts.setdefault(r.kind, []).append(r.word)
    ours = document_marks(docs, ["doc_id"], asked, lambda at, h: h, firsts if len(few) <= ANCHORS else None).withColumnRenamed("w", "hash")
    maybe = scratch.save("maybe", ours.join(small_side(told.select("hash").distinct()), "hash", "left_semi").select("doc_id").distinct())

    # they are read again, with every place of every window
    text_id = F.xxhash64("text")
    read = lambda df, key, name, which: df.join(small_side(which.select(key).distinct()), key, "left_semi").where("text is not null").select(key, "text", text_id.alias(name)).distinct()
    doc_rows = scratch.save("docs", read(docs, "doc_id", "doc_text", maybe))
    ours = document_marks(doc_rows, ["doc_id", "doc_text"], asked, lambda at, h: F.struct(at.alias("at"), h.alias("hash")))
    ours = scratch.save("places", ours.select("doc_id", "doc_text", "w.at", "w.hash").join(small_side(first.select("hash").distinct()), "hash", "left_semi"))
    held = ours.select("doc_id", "hash").distinct().join(small_side(first), "hash").groupBy("doc_id", *of, "windows").agg(F.count("*").alias("held"))
    likely = scratch.save("likely", held.where(F.col("held") >= COVERAGE * F.col("windows")).select("doc_id", *of))
    item_rows = scratch.save("texts", read(items, "item_id", "item_text", likely))
    every = parts.join(likely, of).join(ours, ["doc_id", "hash"])
    shift, cell = F.col("at") - F.col("item_at"), CELL * F.col("length")
    sets = [("exact", shift), ("low", F.floor(shift / DRIFT)), ("high", F.floor((shift + DRIFT // 2) / DRIFT)), ("cell", F.floor(F.col("at") / cell)), ("half", F.floor((F.col("at") + cell / 2) / cell))]
    aligned = every.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("by"), v.cast("long").alias("at")) for k, v in sets])).alias("passage"))
    judged = ["doc_id", "doc_text", *of, "windows", "passage"]
    firsts = aligned.groupBy(*judged, "hash", "item_at").agg(F.min("at").alias("at"))
    held = firsts.groupBy(*judged).agg(F.count_distinct("hash").alias("matched"), F.collect_set(F.struct("item_at", "at")).alias("places"))
    passing = scratch.save("passing", held.where(F.col("matched") >= COVERAGE * F.col("windows")))
    cut = lambda df, key, name, form, to: marked(df, key, name).select(key, name, words(F.col("m"), form).alias(to))
    along = lambda p: F.transform(
        F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda j: F.struct(F.get("theirs", p["item_at"] + j).alias("asked"), F.get("ours", p["at"] + j).alias("found"))
    )
    out = []
    for kinds, form in ((["slots"], "named"), (["plain", "valued", "alone"], "valued")):
        both = (
            passing.where(F.col("kind").isin(kinds))
            .join(cut(doc_rows, "doc_id", "doc_text", form, "ours"), ["doc_id", "doc_text"])
            .join(cut(item_rows, "item_id", "item_text", form, "theirs"), ["item_id", "item_text"])
        )
        pairs = F.array_distinct(F.filter(F.flatten(F.transform("places", along)), lambda p: p["asked"].startswith("#")))
        valued = both.select(*judged, "matched", pairs.alias("pairs"))
        valued = valued.withColumn("asked", F.array_distinct(F.transform("pairs", lambda p: p["asked"])))
        settled = F.filter("asked", lambda a: F.size(F.filter(F.col("pairs"), lambda p: p["asked"] == a)) == 1)
        out.append(
            valued.select(
                "doc_id",
                "item_id",
                "matched",
                "windows",
                F.size("asked").alias("slots"),
                F.when(F.size("asked") == 0, 1.0).otherwise(F.size(settled) / F.greatest(F.size("asked"), F.lit(1))).alias("consistency"),
                F.forall("pairs", lambda p: p["asked"].eqNullSafe(p["found"])).alias("same"),
            )
        )
    out = out[0].unionByName(out[1])
    coverage = F.col("matched") / F.col("windows")
    best = out.where(F.col("consistency") >= CONSISTENCY).groupBy("doc_id", "item_id").agg(F.max(F.struct("same", coverage.alias("coverage"), "matched", "consistency", "slots", "windows")).alias("best"))
    return best.select(
        "doc_id",
        "item_id",
        "best.matched",
        "best.windows",
        "best.coverage",
        "best.slots",
        "best.consistency",
        F.when(F.col("best.same"), "copy").otherwise("reparameterised").alias("kind"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without contaminated documents; rows without a doc_id stay."""
    scratch = Scratch(docs.sparkSession, "decontaminated")
    hits = scratch.save("hits", contamination(docs, benchmark).select("doc_id").distinct())
    return docs.join(small_side(hits), "doc_id", "left_anti").select(docs.columns)
