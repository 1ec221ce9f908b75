"""Personal data by candidate gradient boosting, in DataFrame functions only.

Generators of high recall propose spans that may overlap. Each candidate has two views: its
format, binned into the trees' features, and its context, the words before it, which gives a weak
label that the features don't hold. Candidates of one fold of documents are counted by feature
cell (``CELLS`` at most, whatever the input's size) and boosted trees are fitted on the cells. The
other fold calibrates: per kind the lowest score at which labelled candidates make up
``PRECISION`` of what is selected becomes the threshold. The cells' scores decide over all
candidates, whatever their context. Of selected spans that overlap, the one of higher score
stays, the earlier one on ties. The base rules' spans always stay; added ones overlap none of
them.

Patterns that equal the base rules are written with possessive quantifiers and guards, so that
no text makes them backtrack more than its length.

Defined results: a null text counts as empty and has no spans; repeated rows each give a row;
other columns are ignored; an empty table gives an empty table; with fewer than two classes of
weak labels no span is added.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from pacegrid.llm import common

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
BASE = ("email", "ip", "card", "phone")

#: Generators: tokens of letters and digits, long numbers, spelt-out addresses.
EXTRA = ("secret", "number", "handle")
SECRET = r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])(?=[0-9_]*+[A-Za-z])[A-Za-z0-9_]{12,}+"
NUMBER = r"(?<![0-9A-Za-z.+])\(?[0-9]++(?:[\x20().-]{1,2}[0-9]++){1,8}+(?![0-9A-Za-z])"
HANDLE = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++ ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z]{2,}+"

#: Words before a span that speak for it: the weak labels.
CUES = {
    "secret": r"(?i)(?:pass(?:word|wd)?|token|secret|auth|(?:api|access|private)[_ -]?key)[_a-z]{0,8}[\x20\"']{0,2}[=:]?[\x20\"']{0,2}$",
    "number": r"(?i)(?:ssn|social security|phone|call|tel|mobile|fax|whatsapp|number|no)[\x20.:#]{1,3}(?:is |at |me at |us at )?$",
    "handle": r"(?i)(?:e-?mail|mail|contact|write|reach|me|us|at|to)[\x20:]{1,2}$",
}

PRECISION, TREES, DEPTH = 0.9, 10, 3
BINS = {"kind": 3, "long": 8, "digits": 4, "upper": 3, "breaks": 4, "shape": 4}
CELLS = 3 * 8 * 4 * 3 * 4 * 4
#: Folds of documents; the trees learn from all but the first, which sets the thresholds.
FOLDS = 3
#: Elements of a block of a running total.
BLOCK = 256


def bound(value: Column, body) -> Column:
    """``body`` of a variable that holds ``value``: named inside a lambda, an expression is made
    again for each element, a variable isn't."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, merge, start: Column) -> Column:
    """Running totals of an array under ``merge``. A fold with a growing list copies the list for
    each element; here totals go over blocks and then within each block."""
    block = lambda i: F.floor(i / BLOCK).cast("int")

    def totals(t: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), block(F.greatest(F.size(t) - 1, F.lit(0)))), lambda k: F.aggregate(F.slice(t, k * BLOCK + 1, F.lit(BLOCK)), start, merge))
        heads = lambda sums: F.transform(sums, lambda _, k: F.aggregate(F.slice(sums, F.lit(1), k), start, merge))
        inside = lambda heads: F.transform(t, lambda _, i: F.aggregate(F.slice(t, block(i) * BLOCK + 1, i % BLOCK + 1), F.get(heads, block(i)), merge))
        return bound(sums, lambda sums: bound(heads(sums), inside))

    return bound(values, totals)


def later(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def sooner(a: Column, b: Column) -> Column:
    return F.least(a, b)


def spans(text: Column, pattern: str, guard: Column) -> Column:
    """(s, e, v, before, after) of the pattern's matches, left to right: the texts between
    matches give their places, in code points."""
    none = F.array().cast("array<string>")
    values = F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    gaps = F.when(guard, F.split(text, pattern, -1)).otherwise(none)
    both = F.arrays_zip(values.alias("v"), gaps.alias("g"), F.slice(gaps, F.lit(2), F.lit(2**31 - 1)).alias("n"))
    length = lambda x: F.length(x["g"]) + F.coalesce(F.length(x["v"]), F.lit(0))

    def row(x: Column, e: Column) -> Column:
        return F.struct((e - F.length(x["v"])).alias("s"), e.alias("e"), x["v"].alias("v"), F.right(x["g"], F.lit(32)).alias("before"), F.left(x["n"], F.lit(1)).alias("after"))

    rows = lambda z: bound(running(F.transform(z, length), lambda a, b: a + b, F.lit(0)), lambda ends: F.transform(z, lambda x, i: row(x, F.get(ends, i))))
    found = F.filter(bound(both, rows), lambda x: x["v"].isNotNull())
    kind = "array<struct<s:int,e:int,v:string,before:string,after:string>>"
    return F.when(F.size(values) == 0, F.array().cast(kind)).otherwise(found)


def luhn(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return n.between(16, 19) & (F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0)


def base_spans(text: Column, digit: Column) -> dict[str, Column]:
    """The base rules' spans by kind."""
    ok = {
        "email": lambda v: F.lit(True),
        "ip": lambda v: v.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"),
        "card": luhn,
        "phone": lambda v: F.length(F.regexp_replace(v, "[^0-9]", "")).between(8, 15),
    }
    guards = {"email": F.contains(text, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+")) & digit}
    found = {k: spans(text, p, guards[k]) for k, p in zip(BASE, (EMAIL, IP, CARD, PHONE), strict=True)}
    strict = lambda kind: lambda x: ok[kind](x["v"])
    return {k: F.filter(c, strict(k)) for k, c in found.items()}


def _binned(value: Column, *edges: float) -> Column:
    out = F.lit(0)
    for edge in edges:
        out = out + (value >= edge).cast("int")
    return out


def _cell(kind: int, x: Column) -> Column:
    """Number of the candidate's feature cell: its format only."""
    v, n = x["v"], F.length(x["v"])
    digits = F.length(F.regexp_replace(v, "[^0-9]", "")) / n
    upper = F.length(F.regexp_replace(v, "[^A-Z]", "")) / n
    breaks = F.length(F.regexp_replace(v, "[A-Za-z0-9]", ""))
    changes = F.regexp_count(v, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])")) / n
    parts = {
        "kind": F.lit(kind),
        "long": _binned(n, 13, 16, 20, 21, 32, 36, 40),
        "digits": _binned(digits, 0.2, 0.5, 0.75),
        "upper": _binned(upper, 0.2, 0.6),
        "breaks": _binned(breaks, 1, 2, 4),
        "shape": _binned(changes, 0.05, 0.15, 0.3),
    }
    out = F.lit(0)
    for name, bins in BINS.items():
        out = out * bins + parts[name]
    return out


def candidates(text: Column, digit: Column) -> Column:
    """(kind, s, e, cell, cued) of all generators' spans."""
    guards = {"secret": digit, "number": digit, "handle": F.contains(text, F.lit("at)")) | F.contains(text, F.lit("at]"))}

    def row(i: int, kind: str):
        return lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), _cell(i, x).alias("cell"), x["before"].rlike(CUES[kind]).alias("cued"))

    found = zip(EXTRA, (SECRET, NUMBER, HANDLE), strict=True)
    out = [F.transform(spans(text, pattern, guards[kind]), row(i, kind)) for i, (kind, pattern) in enumerate(found)]
    return F.concat(*out)


def _ordered(items: Column) -> Column:
    """Items by start, what ends first on ties."""
    rows = F.transform(items, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x.alias("x")))
    return F.transform(F.array_sort(rows), lambda r: r["x"])


def free_of(base: Column, found: Column) -> Column:
    """The candidates that overlap no base span, by start. All stand in one order by start: a base
    span before a candidate must end before its start, the first one after it start at its end or
    later."""
    mine = F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x.alias("c")))
    empty = F.lit(None).cast("struct<kind:string,s:int,e:int,cell:int,cued:boolean>")
    other = F.transform(base, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), empty.alias("c")))
    far = 2**31 - 1
    pick = lambda rows, field, otherwise: F.transform(rows, lambda x: F.when(x["c"].isNull(), x[field]).otherwise(otherwise))

    def apart(rows: Column) -> Column:
        ends = running(pick(rows, "e", -1), later, F.lit(-1))
        starts = F.reverse(running(F.reverse(pick(rows, "s", far)), sooner, F.lit(far)))
        marked = lambda both: F.transform(rows, lambda x, i: F.when((F.get(both["ends"], i) <= x["s"]) & (F.get(both["starts"], i) >= x["e"]), x["c"]))
        return bound(F.struct(ends.alias("ends"), starts.alias("starts")), marked)

    return F.filter(bound(_ordered(F.concat(mine, other)), apart), lambda c: c.isNotNull())


def proposed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One written row per document: doc_id, calibrates, the base spans by kind, and the candidates
    that overlap none of them, by start."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("digit", F.col("text").rlike("[0-9]"))
    base = base_spans(F.col("text"), F.col("digit"))
    rows = rows.select("doc_id", *(c.alias(k) for k, c in base.items()), candidates(F.col("text"), F.col("digit")).alias("found"))
    places = lambda k: F.transform(F.col(k), lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    rows = rows.select("doc_id", F.concat(*map(places, BASE)).alias("base"), "found")
    free = F.when(F.size("found") == 0, F.col("found")).otherwise(free_of(F.col("base"), F.col("found")))
    held = F.coalesce(common.crc32_bucket("doc_id", FOLDS) == 0, F.lit(False))
    return common.written(rows.select("doc_id", held.alias("calibrates"), "base", free.alias("found")), "pii-spans")


def selected_cells(rows: DataFrame) -> dict[int, float]:
    """Scores of the cells whose candidates are to be redacted. All candidates are counted by cell
    and fold; the trees see the cells, which are at most ``CELLS``."""
    each = rows.select("calibrates", F.explode("found").alias("c")).groupBy("c.cell", "calibrates").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("c.cued").cast("double")).alias("yes"))
    cells = common.written(each, "pii-cells")
    columns, rest = [], F.col("cell")
    for name, bins in reversed(BINS.items()):
        columns.append(F.pmod(rest, F.lit(bins)).cast("double").alias(name))
        rest = F.floor(rest / bins)
    wide = cells.select("cell", "calibrates", "n", "yes", *columns)
    learn = wide.filter("not calibrates")
    sides = [learn.withColumn("label", F.lit(float(k))).withColumn("weight", w) for k, w in ((1, F.col("yes")), (0, F.col("n") - F.col("yes")))]
    sides = sides[0].unionByName(sides[1]).filter("weight > 0")
    if sides.select("label").distinct().count() < 2:
        return {}
    assembled = VectorAssembler(inputCols=list(BINS), outputCol="features")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, weightCol="weight", seed=11, maxBins=8).fit(assembled.transform(sides.coalesce(1)))
    scored = trees.transform(assembled.transform(wide)).select("cell", "calibrates", "kind", "n", "yes", F.round(vector_to_array("probability")[1], 9).alias("score"))
    down = Window.partitionBy("kind").orderBy(F.col("score").desc()).rangeBetween(Window.unboundedPreceding, 0)
    held = scored.filter("calibrates").withColumn("precision", F.sum("yes").over(down) / F.sum("n").over(down))
    limits = held.filter(F.col("precision") >= PRECISION).groupBy("kind").agg(F.min("score").alias("limit"))
    chosen = scored.join(F.broadcast(limits), "kind").filter("score >= limit").select("cell", "score").distinct()
    return {r["cell"]: r["score"] for r in chosen.collect()}


def resolved(found: Column, scores: dict[int, float]) -> Column:
    """(kind, s, e) of the selected candidates, which stand by start. A candidate that overlaps the
    one kept before it replaces it if its score is higher, else goes. Only those that overlap
    another are folded."""
    table = F.create_map(*(F.lit(x) for pair in sorted(scores.items()) for x in pair))
    row = lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"), F.element_at(table, c["cell"]).alias("score"))
    chosen = F.transform(F.filter(found, lambda c: c["cell"].isin(sorted(scores))), row)
    kept_type = "array<struct<s:int,e:int,kind:string,score:double>>"

    def choose(rows: Column) -> Column:
        def marked(ends: Column) -> Column:
            before = lambda i: (i > 0) & (F.get(ends, i - 1) > F.get(rows, i)["s"])
            after = lambda i: F.coalesce(F.get(rows, i + 1)["s"] < F.get(rows, i)["e"], F.lit(False))
            return F.transform(rows, lambda x, i: F.struct(x.alias("x"), (before(i) | after(i)).alias("clash")))

        def merge(out: Column, x: Column) -> Column:
            last = F.get(out, F.size(out) - 1)
            clash = F.coalesce(x["s"] < last["e"], F.lit(False))
            swap = F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(x))
            return F.when(~clash, F.concat(out, F.array(x))).when(x["score"] > last["score"], swap).otherwise(out)

        def split(both: Column) -> Column:
            alone = F.transform(F.filter(both, lambda y: ~y["clash"]), lambda y: y["x"])
            crossed = F.transform(F.filter(both, lambda y: y["clash"]), lambda y: y["x"])
            return F.array_sort(F.concat(alone, F.aggregate(crossed, F.array().cast(kept_type), merge)))

        return bound(bound(running(F.transform(rows, lambda x: x["e"]), later, F.lit(-1)), marked), split)

    places = lambda rows: F.transform(rows, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return F.when(F.size(found) == 0, F.array().cast("array<struct<kind:string,s:int,e:int>>")).otherwise(places(bound(chosen, choose)))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, all): arrays of (kind, s, e) by kind in the order of ``BASE`` and ``EXTRA``,
    then start; ends are exclusive."""
    rows = proposed(docs, id_col, text_col)
    scores = selected_cells(rows)
    added = resolved(F.col("found"), scores) if scores else F.array().cast("array<struct<kind:string,s:int,e:int>>")
    rows = rows.select("doc_id", "base", added.alias("added"))
    of_kind = lambda kind: F.filter("added", lambda x: x["kind"] == kind)
    return rows.select(F.col("doc_id").alias(id_col), "base", F.concat("base", *map(of_kind, EXTRA)).alias("all"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every found span's text replaced by ``<kind>``; spans that overlap are replaced
    together, by the first one's kind. Rows are matched by id, which must be unique. Each piece is
    cut from the whole text, so work grows with a text's length times its spans."""
    ordered = F.array_sort(F.transform("all", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    found = find(docs, id_col, text_col).select(F.col(id_col).alias("__id"), ordered.alias("__spans"))
    text = F.coalesce(F.col(text_col), F.lit(""))

    def written_out(ends: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
        piece = lambda x, i: F.concat(F.substring(text, before(i) + 1, x["s"] - before(i)), F.lit("<"), x["kind"], F.lit(">"))
        pieces = F.transform("__spans", lambda x, i: F.when(x["s"] >= before(i), piece(x, i)).otherwise(""))
        last = F.coalesce(F.array_max(ends), F.lit(0))
        return F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.length(text)))

    done = bound(running(F.transform("__spans", lambda x: x["e"]), later, F.lit(0)), written_out)
    joined = docs.join(found, docs[id_col].eqNullSafe(found["__id"]), "left")
    return joined.withColumn(text_col, F.when(F.size("__spans") > 0, done).otherwise(text)).select(*docs.columns)


def op4_pii_boosting(spark, sf_dir: str) -> DataFrame:
    found = find(common.read_table(spark, sf_dir, "documents"))
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), F.sha2(said("base").cast("binary"), 256).alias("base_sha256"), said("all").alias("spans"))
