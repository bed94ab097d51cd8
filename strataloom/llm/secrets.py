"""Secret scans: patterns, and character Markov models compared by log-likelihood ratio.

Two first-order character models, of random strings and of ordinary identifiers, are trained by counting the bigrams of
labelled samples. Runs of key characters outside what the patterns find are scored by the ratio of their bigrams; the stretch of
a run with the greatest sum is a secret if its ratio is high enough, as a whole and for each bigram, so an ordinary path or name beside a key neither hides
nor joins it. Everything is DataFrame functions: a pattern's matches and the pieces between them give the
spans, added up in blocks, so the work grows with the text and not with the square of its matches.

Defined results: a null or empty text has no spans. Spans are in code points, end exclusive. Very long texts are scanned whole. Repeated rows get the same
spans. With an empty sample of either kind the models are uniform and add nothing. Other columns are never read, whatever their names. An empty table gives
an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.text import columns

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The patterns of the base kinds, in their order, and the least lengths of their matches.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = "(" + "|".join(map(_either_case, KEYWORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "markov")
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
LEAST_VALUE = 6
#: Characters of a run and of a stretch, and nats of log-likelihood ratio for a stretch and for each of its bigrams.
LEAST_LENGTH, LEAST_RATIO, LEAST_MEAN = 12, 12.0, 0.5
RUN = f"[A-Za-z0-9+/_=-]{{{LEAST_LENGTH},}}"
#: Matches added up at once.
BLOCK = 128

# Words that ordinary identifiers are made of in the default sample.
WORDS = "user name file path index count value list item node data size time date type group order price table column row key hash map set get add remove update delete insert select from where join left right outer inner first last next previous start stop begin end open close read write load save parse format print string number integer float double boolean array object class method function module package import export default static public private final const return result error warning message status code response request client server session cache buffer stream thread process queue stack tree graph edge vertex point line color width height length offset limit total average minimum maximum thing nation station with that there here them then other another".split()


def samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Labelled samples (text, random): hashed bytes in two alphabets, and identifiers of two to four words or of digits."""
    words = F.lit(WORDS)
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))) + 1).cast("int"))
    hashed = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(hashed)), r"\s", "")
    random = F.when(F.col("id") % 3 == 0, F.substring(hashed, 1, 40)).otherwise(F.substring(base64, 1, 40))
    ids = spark.range(n)
    snake, camel = F.concat_ws("_", pick(1), pick(2), pick(3)), F.concat(pick(1), F.initcap(pick(2)), F.initcap(pick(3)))
    plain, upper = F.concat(pick(1), pick(2), pick(3), pick(4)), F.upper(F.concat_ws("_", pick(1), pick(2)))
    dashed = F.concat_ws("-", pick(1), pick(2), F.pmod(F.col("id"), F.lit(100)).cast("string"))
    number = F.translate(F.substring(hashed, 1, 16), "abcdef", "012345")
    kind = F.pmod(F.col("id"), F.lit(7))
    ordinary = F.when(kind == 0, snake).when(kind == 1, camel).when(kind == 2, upper).when(kind == 3, dashed).when(kind == 4, number).otherwise(plain)
    return ids.select(random.alias("text"), F.lit(True).alias("random")).unionByName(ids.select(ordinary.alias("text"), F.lit(False).alias("random")))


def _bigrams(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)(?=(..))"), F.lit(1))


def train(labelled: DataFrame, smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratios of all bigrams over the alphabet, first character by first character."""
    k = len(ALPHABET)
    counts = {True: {}, False: {}}
    rows = labelled.where("text IS NOT NULL AND random IS NOT NULL").select("random", F.explode(_bigrams(F.col("text"))).alias("g"))
    for r in rows.where(F.col("g").rlike(f"^[{ALPHABET[:-1]}-]{{2}}$")).groupBy("random", "g").count().collect():  # at most 2 * k * k rows
        counts[r["random"]][r["g"]] = r["count"]
    if not counts[True] or not counts[False]:
        return [0.0] * (k * k)
    out = []
    for a in ALPHABET:
        of = {kind: sum(counts[kind].get(a + b, 0) for b in ALPHABET) for kind in counts}
        for b in ALPHABET:
            p, q = ((counts[kind].get(a + b, 0) + smooth) / (of[kind] + smooth * k) for kind in (True, False))
            out.append(math.log(p / q))
    return out


def stretch(run: Column, table: list[float]) -> Column:
    """The stretch of a run with the greatest log-likelihood ratio, random against ordinary: (sum, first and end character, from 0)."""
    values = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    code = lambda c: F.instr(F.lit(ALPHABET), c)
    at = lambda g: (code(F.substring(g, 1, 1)) - 1) * len(ALPHABET) + code(F.substring(g, 2, 1))
    layout = "struct<place: int, sum: double, since: int, most: double, first: int, end: int>"

    def step(acc, g):
        place, more = acc["place"], F.element_at(values, at(g))
        total = F.greatest(acc["sum"], F.lit(0.0)) + more
        since = F.when(acc["sum"] > 0, acc["since"]).otherwise(place)
        better = total > acc["most"]
        new = (place + 1, total, since, F.greatest(total, acc["most"]), F.when(better, since).otherwise(acc["first"]), F.when(better, place + 2).otherwise(acc["end"]))
        return F.struct(*new).cast(layout)

    start = F.struct(F.lit(0), F.lit(0.0), F.lit(0), F.lit(0.0), F.lit(0), F.lit(0)).cast(layout)
    return F.aggregate(_bigrams(run), start, step)


_SPAN = "struct<kind: int, start: int, end: int, value: string>"
_SPANS = f"array<{_SPAN}>"


def spans(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """All leftmost non-overlapping matches: kind, start, end, and the group's text."""
    p = F.lit(pattern)
    pieces, matches, values = F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group))
    sizes = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("size")))
    zipped = F.zip_with(sizes, values, lambda x, v: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), v.alias("value")))
    def within(block, begin):
        start = F.struct(begin.alias("at"), F.array().cast(_SPANS).alias("out")).cast(f"struct<at: int, out: {_SPANS}>")

        def step(acc, x):
            first = acc["at"] + x["gap"]
            end = first + x["size"]
            one = F.struct(F.lit(kind).alias("kind"), first.alias("start"), end.alias("end"), x["value"].alias("value")).cast(_SPAN)
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out")).cast(f"struct<at: int, out: {_SPANS}>")

        return F.aggregate(block, start, step)["out"]

    total = lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + x["gap"] + x["size"])
    before = lambda blocks: F.aggregate(F.transform(blocks, total), F.array(F.lit(0)), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))
    cut = lambda z: F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / BLOCK).cast("int")), lambda k: F.slice(z, k * BLOCK + 1, F.lit(BLOCK)))
    # A lambda's variable is evaluated once, an expression inside a lambda again for each element.
    once = lambda array, f: F.element_at(F.transform(F.array(array), f), 1)
    found = F.flatten(once(once(zipped, cut), lambda blocks: F.zip_with(blocks, F.slice(before(blocks), F.lit(1), F.size(blocks)), within)))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPANS))


def blanked(text: Column, pattern: str, least: int = 0, group: int = 0) -> Column:
    """The text with spaces in place of the matches whose group has at least ``least`` characters."""
    p = F.lit(pattern)
    pieces, matches, values = F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group))
    blanks = F.zip_with(matches, values, lambda m, v: F.when(F.length(v) >= least, F.repeat(F.lit(" "), F.length(m))).otherwise(m))
    whole = F.array_join(F.zip_with(pieces, F.concat(blanks, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    return F.when(text.rlike(pattern), whole).otherwise(text)


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, base and added: arrays of spans (kind number, start, end, value), by start and kind.

    ``labelled`` (text, random: boolean) has samples of both kinds; without it they are made.
    """
    table = train(samples(docs.sparkSession) if labelled is None else labelled)
    texts = columns(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    assign = F.filter(spans(text, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= LEAST_VALUE)
    found = texts.select(
        "id", F.array_sort(F.concat(assign, spans(text, ACCESS, 1), spans(text, HEX, 2)), _by_start).alias("base"),
        blanked(blanked(blanked(text, ASSIGN, LEAST_VALUE, 2), ACCESS), HEX).alias("rest"),
    )
    runs = found.select("id", "base", spans(F.col("rest"), RUN, 3).alias("runs"))
    scored = F.transform("runs", lambda s: F.struct(s.alias("run"), stretch(s["value"], table).alias("best")))
    size = lambda x: x["best"]["end"] - x["best"]["first"]
    likely = lambda x: (size(x) >= LEAST_LENGTH) & (x["best"]["most"] >= F.greatest(F.lit(LEAST_RATIO), LEAST_MEAN * (size(x) - 1)))
    cut = lambda x: F.struct(
        F.lit(3).alias("kind"), (x["run"]["start"] + x["best"]["first"]).alias("start"), (x["run"]["start"] + x["best"]["end"]).alias("end"),
        F.substring(x["run"]["value"], x["best"]["first"] + 1, size(x)).alias("value"),
    ).cast(_SPAN)
    return runs.select("id", "base", F.transform(F.filter(scored, likely), cut).alias("added"))


def _by_start(a: Column, b: Column) -> Column:
    key = lambda s: s["start"].cast("long") * len(KINDS) + s["kind"]
    return F.signum(key(a) - key(b)).cast("int")


def listing(spans_col: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(listing(F.col("base")), 256).alias("base_sha256"), listing(F.array_sort(F.concat("base", "added"), _by_start)).alias("spans"),
    )
