"""Benchmark questions in documents, re-parameterised ones included.

Texts are brought to templates: numbers, units after numbers, and names (capitalised words inside a
sentence) become typed placeholders, the rest is lower case without punctuation. Windows of
``WINDOW`` template tokens are hashed (those of little but placeholders with their values, so that exact
copies of them are met). A second template leaves names as words, so that it does not depend on case. A
window is hashed once where its forms agree. A document whose window hash is among the benchmark's is
looked at closely: its windows are joined with the benchmark's by hash and counted along one
alignment, and the values in the placeholders are compared. Windows with the item's own values count
as they are. A re-parameterised question replaces each value by one other throughout, so of the
windows with other values the longest run counts in which values map one to one within a type; where
the same value stands for two, the template has only been met by chance. What is found in a part
of a document is thus found in the whole.

DataFrame functions only. The benchmark's distinct hashes are broadcast if there are at most
``BROADCAST`` of them, and joined by shuffle otherwise; documents are never expanded into pairs with
items, only into their own windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickwork.llm.tables import written

WINDOW = 8
#: Windows with fewer words that are no placeholders are no evidence as templates; they count where their
#: values are the same.
WORDS = 4
#: Forms of a text by which windows are met: templates; templates whose names are words, whatever their
#: case; and words and values as they are (case aside).
FORMS = ("canon", "blind", "raw")
#: So many windows of one alignment (13 tokens), or three quarters of an item's where that is less.
ENOUGH = 6
BROADCAST = 500_000

#: Marks of the placeholders, from the private use area.
NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"
#: Units that may follow a number as a word of their own.
UNITS = (
    "mm|cm|dm|km|m|mg|kg|g|t|lb|lbs|oz|ml|cl|dl|l|s|ms|min|h|hr|hrs|seconds?|minutes?|hours?|days?|weeks?|months?|years?|"
    "meters?|metres?|miles?|feet|foot|inch|inches|grams?|liters?|litres?|percent|dollars?|euros?|cents?|usd|eur|gb|mb|kb|hz|khz|mhz|kw|v|w"
)


#: White space, as a class of characters; any run of it is one space.
SPACES = r"\s\u0085\u00a0\u2000-\u200a\u2028\u2029\u202f\u3000"


def marked(text: Column) -> Column:
    """The text with a mark before each name, number and unit, and without punctuation."""
    out = F.regexp_replace(text, rf"[{SPACES}&&[^ ]][{SPACES}]*+| [{SPACES}]++", " ")
    # Units first: they are units in any case.
    out = F.regexp_replace(out, rf" (?<=[0-9] )(?=(?i:{UNITS})(?![\p{{L}}\p{{N}}]))", f" {UNIT}")
    out = F.regexp_replace(out, r" (?<![\s.!?:;] )(?=\p{Lu}\p{Ll}++(?!\p{L}))", f" {NAME}")
    out = F.regexp_replace(out, r"[0-9](?:[.,:/]?[0-9])*+", f"{NUMBER}$0")
    return F.regexp_replace(out, rf"[^\p{{L}}\p{{M}}\p{{N}}\s{NAME}{NUMBER}{UNIT}]+", "")


def template(text: Column) -> Column:
    """A marked text's placeholders without their values, other words in lower case."""
    return F.lower(F.regexp_replace(text, rf"([{NAME}{NUMBER}{UNIT}])[^\s{NAME}{NUMBER}{UNIT}]*+", "$1"))


def nameless(text: Column) -> Column:
    """A marked text's numbers and units without their values, all other words, names too, in lower case."""
    return template(F.translate(text, NAME, ""))


def values(text: Column) -> Column:
    """A marked text's words and values in lower case. Numbers keep their marks, so that 3 + 4 is not 34."""
    return F.lower(F.translate(text, NAME + UNIT, ""))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def in_forms(texts: DataFrame, *keys: str) -> DataFrame:
    """The ``keys`` and the tokens of column ``_marked`` in each form; all forms have the same tokens."""
    of = {"canon": template, "blind": nameless, "raw": values}
    return texts.select(*keys, *[tokens(of[form](F.col("_marked"))).alias(form) for form in FORMS])


def _window_hashes(length: int, values: int | None) -> Column:
    """The hashes of all windows in all forms, each once where forms agree; none where there are fewer words.

    A form's window is hashed where it can differ from the others: without names the two templates are
    one, and without numbers and units so are template and values. ``values`` is the least number of
    those in a benchmark window that is met by its values; null if there is none.
    """
    last = F.size("canon") - length

    def at(form: str, starts: Column) -> Column:
        return F.transform(starts, lambda i: F.xxhash64(F.slice(form, i + 1, F.lit(length))))

    def holding(places: str, least: int) -> Column:
        """Starts of the windows that hold ``least`` or more of the places."""

        def around(j: Column) -> Column:
            low = F.greatest(F.get(places, j + (least - 1)) - (length - 1), F.lit(0))
            high = F.least(F.get(places, j), last)
            return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

        some = F.when(F.size(places) >= least, F.sequence(F.lit(0), F.size(places) - least)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.flatten(F.transform(some, around)))

    hashes = [at("canon", F.sequence(F.lit(0), last)), at("blind", holding("_names", 1))]
    if values is not None:
        hashes.append(at("raw", holding("_values", values)))
    return F.when(last >= 0, F.flatten(F.array(*hashes)))


def _places(*marks: str) -> Column:
    """The places of these marks in the template."""
    every = F.when(F.size("canon") > 0, F.sequence(F.lit(0), F.size("canon") - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda i: F.get("canon", i).isin(*marks))


def _is_mark(token: Column) -> Column:
    return token.substr(1, 1).isin(NAME, NUMBER, UNIT)


def _windows(texts: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Rows (keys, at, found, hash), one per window and distinct form, for a frame with token arrays."""
    last = F.size("raw") - width
    starts = F.when(last >= 0, F.sequence(F.lit(0), last))
    rows = texts.select(*keys, *FORMS, F.explode(starts).alias("at"))
    window = {form: F.slice(form, F.col("at") + 1, F.lit(width)) for form in FORMS}
    hashes = F.array_distinct(F.array(*[F.xxhash64(window[form]) for form in FORMS]))
    rows = rows.select(*keys, "at", window["raw"].alias("found"), hashes.alias("_hashes"))
    return rows.select(*keys, "at", "found", F.explode("_hashes").alias("hash"))


def benchmark_windows(benchmark: DataFrame, width: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, item (key), size (window length), pos, raw, canon, free, form, hash, n_values, n_windows, n_free.

    An item shorter than a window is one window of its own length. A first word in upper case may be
    a name where the item is quoted inside a sentence, so its window is there both ways. Windows
    with enough words are ``free``: their values may differ. Others are there with their values.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("text is not null").distinct()
    items = items.withColumn("item", F.xxhash64("item_id", "text")).withColumn("_marked", marked(F.col("text")))
    items = items.withColumn("_first", tokens(F.col("_marked"))[0])
    items = in_forms(items, "item_id", "item", "_first").where("size(canon) > 0")
    rest = F.slice("canon", F.lit(2), F.greatest(F.size("canon") - 1, F.lit(0)))
    quoted = items.where(F.col("_first").rlike(r"^\p{Lu}\p{Ll}+$")).withColumn("canon", F.concat(F.array(F.lit(NAME)), rest))
    both = items.withColumn("_as_is", F.lit(True)).unionByName(quoted.withColumn("_as_is", F.lit(False)))
    both = both.withColumn("size", F.least(F.size("canon"), F.lit(width)))
    rows = both.select("*", F.explode(F.sequence(F.lit(0), F.size("canon") - F.col("size"))).alias("pos")).where("_as_is or pos = 0")
    rows = rows.select("item_id", "item", "size", "pos", "_as_is", *[F.slice(form, F.col("pos") + 1, F.col("size")).alias(form) for form in FORMS])

    def worded(form: str) -> Column:
        return F.size(F.filter(form, lambda t: ~_is_mark(t))) >= F.least(F.lit(WORDS), F.col("size"))

    rows = rows.withColumn("free", worded("canon"))
    other = F.col("blind") != F.col("canon")
    met_by = {"canon": F.col("free"), "blind": F.col("_as_is") & worded("blind") & (other | ~F.col("free")), "raw": F.col("_as_is") & ~F.col("free")}
    forms = F.array(*[F.when(met_by[form], F.struct(F.lit(form).alias("form"), F.xxhash64(form).alias("hash"))) for form in FORMS])
    valued = F.size(F.filter("canon", lambda t: t.isin(NUMBER, UNIT))).alias("n_values")
    rows = rows.select("item_id", "item", "size", "pos", "raw", "canon", "free", valued, F.explode(F.filter(forms, lambda f: f.isNotNull())).alias("_f"))
    counts = rows.groupBy("item").agg(F.count_distinct("pos").alias("n_windows"), F.count_distinct(F.when(F.col("free"), F.col("pos"))).alias("n_free"))
    return rows.select("*", "_f.*").drop("_f").join(counts, "item")


def _one_to_one(slots: Column) -> Column:
    """Whether the pairs of all windows map values one to one."""
    pairs = F.array_distinct(F.flatten(slots))
    return (F.size(pairs) == F.size(F.array_distinct(pairs["raw"]))) & (F.size(pairs) == F.size(F.array_distinct(pairs["found"])))


def _clash(some: Column, others: Column) -> Column:
    """Whether a value of one window's pairs has another partner in the other's."""
    return F.exists(some, lambda p: F.exists(others, lambda q: (p["raw"] == q["raw"]) != (p["found"] == q["found"])))


def _longest_run(windows: Column) -> Column:
    """The longest run of neighbours in ``windows`` (pos, slots) whose values map one to one, the first of equals."""
    none = F.slice(windows, 1, 0)

    def extended(run: Column, window: Column) -> Column:
        last = F.coalesce(F.array_max(F.transform(run, lambda w, i: F.when(_clash(w["slots"], window["slots"]), i + 1).otherwise(0))), F.lit(0))
        return F.when(_clash(window["slots"], window["slots"]), none).otherwise(F.concat(F.slice(run, last + 1, F.size(run)), F.array(window)))

    def step(state: Column, window: Column) -> Column:
        run = extended(state["run"], window)
        return F.struct(run.alias("run"), F.when(F.size(run) > F.size(state["best"]), run).otherwise(state["best"]).alias("best"))

    return F.aggregate(windows, F.struct(none.alias("run"), none.alias("best")), step, lambda state: state["best"])


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WINDOW,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document and benchmark item found in it.

    Columns: doc_id, text_hash, item_id, n_matched (windows of the best alignment), n_windows (of the item),
    start (template token of the document), n_slots, n_changed (values replaced), reparameterised.

    Null and empty texts, of documents or items, match nothing; empty tables give no rows. Repeated
    rows count once; documents that share an id but not the text are told apart by ``text_hash``.
    ``n_slots`` and ``n_changed`` are about the windows counted.
    A document that holds an item several times has it once, at the alignment with the most
    windows, the first of equals. Extra columns play no part.
    """
    items = written(benchmark_windows(benchmark, width), "leaks-benchmark")
    hashes = items.select("hash").distinct()
    small = hashes.count() <= BROADCAST
    least = F.min(F.when((F.col("form") == "raw") & (F.col("n_values") > 0), F.col("n_values")))
    # At most ``width`` rows.
    lengths: dict[int, int | None] = dict(items.groupBy("size").agg(least.alias("values")).orderBy("size").collect())

    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text <> ''")
    keyed = plain.withColumn("text_hash", F.xxhash64("text"))

    def hinted(frame: DataFrame) -> DataFrame:
        return F.broadcast(frame) if small else frame

    formed = keyed.select("doc_id", "text_hash", marked(F.col("text")).alias("_marked")).withColumn("canon", tokens(template(F.col("_marked"))))
    formed = formed.withColumns({"_names": _places(NAME), "_values": _places(NUMBER, UNIT)})
    # The other forms only of texts in which they are looked at.
    formed = formed.withColumns(
        {
            "blind": F.when(F.size("_names") > 0, tokens(nameless(F.col("_marked")))),
            "raw": F.when(F.size("_values") > 0, tokens(values(F.col("_marked")))),
        }
    )
    screened = None
    for length, values_of in lengths.items():
        windows = formed.select("doc_id", "text_hash", F.explode(_window_hashes(length, values_of)).alias("hash"))
        found = windows.join(hinted(hashes), "hash", "left_semi").select("doc_id", "text_hash")
        screened = found if screened is None else screened.unionByName(found)
    if screened is None:
        screened = keyed.select("doc_id", "text_hash").where("false")
    screened = written(screened.distinct(), "leaks-screened").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))

    near = keyed.join(screened, keyed.doc_id.eqNullSafe(screened._id) & (keyed.text_hash == screened._hash), "left_semi")
    near = near.dropDuplicates(["doc_id", "text_hash"]).withColumn("_marked", marked(F.col("text")))
    near = in_forms(near, "doc_id", "text_hash")
    met = None
    for length in lengths:
        mine = _windows(near, ["doc_id", "text_hash"], length)
        theirs = items.where(F.col("size") == length)
        one = mine.join(hinted(theirs) if small else theirs, "hash")
        met = one if met is None else met.unionByName(one)
    if met is None:
        met = _windows(near, ["doc_id", "text_hash"], width).join(items, "hash")

    # Values in placeholders: (what the item has, what the document has), with the kind in front.
    paired = F.filter(F.arrays_zip("canon", "raw", "found"), lambda p: p["canon"].rlike(f"[{NAME}{NUMBER}{UNIT}]"))
    paired = F.transform(paired, lambda p: F.struct(F.concat(p["canon"], p["raw"]).alias("raw"), F.concat(p["canon"], p["found"]).alias("found")))
    keys = ["doc_id", "text_hash", "item", "item_id", "n_windows", "n_free"]
    met = met.select(*keys, "at", "pos", "free", paired.alias("slots"))
    aligned = met.groupBy(*keys, (F.col("at") - F.col("pos")).alias("start")).agg(
        F.array_sort(F.collect_set(F.struct("pos", "free", "slots"))).alias("windows")
    )
    # Once each, though met in several forms.
    aligned = aligned.withColumn("windows", F.filter("windows", lambda w, i: (i == 0) | (F.get("windows", i - 1)["pos"] != w["pos"])))
    verbatim = F.filter("windows", lambda w: F.forall(w["slots"], lambda p: p["raw"] == p["found"]))
    changed = F.filter("windows", lambda w: F.exists(w["slots"], lambda p: p["raw"] != p["found"]))
    aligned = aligned.withColumn("_same", verbatim).withColumn("_other", changed)
    aligned = aligned.withColumn("_other", F.when(_one_to_one(F.col("_other.slots")), F.col("_other")).otherwise(_longest_run(F.col("_other"))))
    aligned = aligned.withColumn("_counted", F.concat("_same", "_other"))
    aligned = aligned.withColumn("n_matched", F.size("_counted")).withColumn("slots", F.array_distinct(F.flatten("_counted.slots")))
    free = F.size(F.filter("_counted", lambda w: w["free"]))

    def enough(of: str) -> Column:
        return F.least(F.lit(ENOUGH), F.ceil(F.col(of) * 0.75))

    # Of all windows, or of those that a re-parameterised copy still has.
    aligned = aligned.where((F.col("n_matched") >= enough("n_windows")) | ((F.col("n_free") > 0) & (free >= enough("n_free"))))
    changed = F.size(F.filter("slots", lambda p: p["raw"] != p["found"]))
    best = aligned.groupBy("doc_id", "text_hash", "item_id").agg(
        F.min_by(
            F.struct("n_matched", "n_windows", "start", F.size("slots").alias("n_slots"), changed.alias("n_changed")),
            F.struct(-F.col("n_matched"), "start", "item"),
        ).alias("b")
    )
    return best.select("doc_id", "text_hash", "item_id", "b.*", (F.col("b.n_changed") > 0).alias("reparameterised"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no item was found, all columns as they are; null texts stay."""
    found = written(leaks(docs, benchmark, width).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "leaks-found")
    same = docs.doc_id.eqNullSafe(found._id) & (F.xxhash64(docs.text) == found._hash)
    return docs.join(found, same, "left_anti")
