"""Secret scans: fixed patterns, and a battery of randomness tests over long tokens. DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, table

#: The base patterns (a match that is too short is dropped; runs of one character class are matched whole).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}+"
HEX = "[0-9a-f]{24,}+"
#: Whole tokens of 20 or more characters.
TOKEN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "random")
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
#: The ten letters that are most frequent in written words.
FREQUENT = "etaoinsrhl"


def _cells(alphabet: str) -> str:
    """For each letter of an alphabet the cell in which the chi-squared test counts it: cells are so large that each is expected to hold
    a few letters of a short token, and words fill some of them more than others."""
    if set(alphabet) <= set(DIGITS):
        return "".join(str(int(c) // 2) for c in alphabet)
    if len(alphabet) == 16:
        return "".join("01"[c > "4"] if c in DIGITS else "23"[c.lower() > "c"] for c in alphabet)
    return "".join(("0" if c in FREQUENT else "1") if c in LOWER else ("2" if c.lower() in FREQUENT else "3") if c in UPPER else "4" for c in alphabet)


def _classes(alphabet: str) -> str:
    """For each letter its class in the runs test: small, capital, digit, other; in alphabets of digits and of hexadecimal digits the half."""
    if len(alphabet) <= 16:
        return "".join("01"[2 * i >= len(alphabet)] for i in range(len(alphabet)))
    return "".join("0" if c in LOWER else "1" if c in UPPER else "2" if c in DIGITS else "3" for c in alphabet)


#: Encodings that are inferred, first match first: characters, alphabet.
ENCODINGS = (
    ("[0-9]+", DIGITS),
    ("[0-9a-f]+", DIGITS + LOWER[:6]),
    ("[0-9A-F]+", DIGITS + UPPER[:6]),
    ("[a-z]+", LOWER),
    ("[A-Z]+", UPPER),
    ("[A-Za-z]+", UPPER + LOWER),
    ("[A-Z2-7]+=*", UPPER + "234567"),
    ("[0-9a-z]+", DIGITS + LOWER),
    ("[0-9A-Z]+", DIGITS + UPPER),
    ("[A-Za-z0-9_-]+=*", UPPER + LOWER + DIGITS + "-_"),
    ("[A-Za-z0-9+/]+=*", UPPER + LOWER + DIGITS + "+/"),
    (".*", UPPER + LOWER + DIGITS + "+/-_="),
)
#: Words and styles of the ordinary tokens that random ones are told from.
WORDS = (
    "about access account after album archive article back base before black blue board book build button cache case center change check "
    "class client code color common config content copy count create current data date default delete detail device domain double edit "
    "element error event every example export field file filter final first folder form front game general get global green group guide "
    "handler header health help history home house image import index info input install item key language large last layer library light "
    "line link list load local login long main manager market master media member message method mobile model module music name network "
    "new news node note number object office old open option order page parent part password path people photo place plan player point "
    "policy price process product profile project public query quick read record region release remote report request result review room "
    "route sample save school search section server service session setting share simple site size small source start state status step "
    "store story style summer support system table target task team template test text theme time title token top total travel type update "
    "user value version video view water web week white window work world year yellow zone"
)
#: p-values are counted in bins of a 1/BINS of a power of ten, up to 10^-DEEPEST.
BINS, DEEPEST = 20, 40


def _hits(text: str, pattern: str, kind: str) -> Column:
    """The matches of one kind in order: how many characters stand since the one before, and the match."""
    p = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr(
        f"CASE WHEN {text} RLIKE {p} THEN filter(transform(arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0)), "
        f"(z, i) -> named_struct('kind', '{kind}', 'pos', i, 'gap', length(z['0']), 'token', z['1'])), x -> x.token IS NOT NULL) END"
    )


def found_tokens(docs: DataFrame) -> DataFrame:
    """row, doc_id, kind, start, end, token of every match, in code points; a document without a match has one row of nulls."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    none = "cast(array() AS array<struct<kind:string,pos:int,gap:int,token:string>>)"
    hits = [F.coalesce(_hits("text", p, k), F.expr(none)) for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN))]
    rows = rows.select("row", "doc_id", F.explode_outer(F.concat(*hits)).alias("h")).select("row", "doc_id", "h.*")
    so_far = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("token")
    rows = rows.withColumn("end", F.sum(F.col("gap").cast("long") + size).over(so_far)).withColumn("start", F.col("end") - size)
    long_enough = (F.col("kind") != "assign") | (F.length(F.regexp_extract("token", ASSIGN, 2)) >= 6)
    return rows.select("row", "doc_id", *(F.when(long_enough, F.col(c)).alias(c) for c in ("kind", "start", "end", "token")))


def _tail(z: Column) -> Column:
    """P(N > z) for a standard normal N, by the series of Abramowitz and Stegun 26.2.17 (error below 1e-7), exponential beyond."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) / 2.5066282746310002 * poly
    return F.greatest(F.when(z >= 0, upper).otherwise(1 - upper), F.lit(1e-300))


def randomness(tokens: DataFrame) -> DataFrame:
    """Adds family, class and score to rows with a token: how little it looks like a random string of its inferred encoding. The result is
    a written table, so that nothing that is asked of it repeats the long expressions.

    The score is the cube root of Fisher's combination of three tests: chi-squared for uniform use of the alphabet, counted in cells
    (by the Wilson-Hilferty normal), the number of runs of one class of letters against its mean and variance for random letters, and
    the correlation of neighbours. Of random strings the combination is chi-squared with six degrees of freedom.
    family: 0 digits, 1 hexadecimal digits, 2 others. class: of lengths 20-31, 32-47, 48-79, 80 and longer.
    """
    at = F.lit(len(ENCODINGS) - 1)
    for i, (chars, _) in reversed(list(enumerate(ENCODINGS[:-1]))):
        at = F.when(F.col("token").rlike(f"^(?:{chars})$"), i).otherwise(at)
    t = tokens.withColumn("_e", at).withColumn("_s", F.regexp_replace("token", "=+$", ""))
    own = lambda of: F.expr("CASE _e " + " ".join(f"WHEN {i} THEN {of(letters)}" for i, (_, letters) in enumerate(ENCODINGS)) + " END")
    shares = lambda of, letters: [of(letters).count(c) / len(letters) for c in sorted(set(of(letters)))]
    power = lambda k: lambda letters: f"{sum(p**k for p in shares(_classes, letters))!r}D"
    t = t.withColumns({
        "_n": F.length("_s").cast("double"), "_letters": own(lambda x: f"'{x}'"), "_cells": own(lambda x: f"'{_cells(x)}'"), "_classes": own(lambda x: f"'{_classes(x)}'"),
        "_shares": own(lambda x: f"array({', '.join(f'{p!r}D' for p in shares(_cells, x))})"), "_names": own(lambda x: f"array({', '.join(repr(c) for c in sorted(set(_cells(x))))})"),
        "_two": own(power(2)), "_three": own(power(3)),
    })
    t = t.withColumn("_v", F.expr("transform(split(_s, ''), c -> cast(instr(_letters, c) - 1 AS double))"))
    t = t.withColumn("_g", F.expr("translate(_s, _letters, _cells)")).withColumn("_c", F.expr("split(translate(_s, _letters, _classes), '')"))
    t = t.withColumn("_chi", F.expr("aggregate(zip_with(_names, _shares, (c, p) -> pow(length(_g) - length(replace(_g, c, '')) - _n * p, 2) / (_n * p)), 0D, (a, x) -> a + x)"))
    t = t.withColumn("_mean", F.expr("aggregate(_v, 0D, (a, x) -> a + x) / _n"))
    t = t.withColumn("_pairs", F.expr("zip_with(slice(_v, 1, size(_v) - 1), slice(_v, 2, size(_v) - 1), (x, y) -> named_struct('x', x, 'y', y))"))
    t = t.withColumn("_ss", F.expr("aggregate(_v, 0D, (a, x) -> a + pow(x - _mean, 2))")).withColumn("_sp", F.expr("aggregate(_pairs, 0D, (a, p) -> a + (p.x - _mean) * (p.y - _mean))"))
    t = t.withColumn("_same", F.expr("aggregate(zip_with(slice(_c, 1, size(_c) - 1), slice(_c, 2, size(_c) - 1), (x, y) -> if(x = y, 1D, 0D)), 0D, (a, x) -> a + x)"))
    n, df, two = F.col("_n"), F.size("_shares") - 1, F.col("_two")
    z_chi = F.when(n > 0, (F.pow(F.col("_chi") / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))).otherwise(F.lit(6.0))
    spread = F.sqrt((n - 1) * two * (1 - two) + 2 * (n - 2) * (F.col("_three") - two * two))
    z_runs = F.when((n > 2) & (spread > 0), (F.col("_same") - (n - 1) * two) / spread).otherwise(F.lit(0.0))  # letters of one class have no runs
    z_serial = F.when(F.col("_ss") > 0, (F.col("_sp") / F.col("_ss") + 1 / n) * F.sqrt(n)).otherwise(F.lit(6.0))
    fisher = -2 * (F.log(_tail(z_chi)) + F.log(F.least(2 * _tail(F.abs(z_runs)), F.lit(1.0))) + F.log(F.least(2 * _tail(F.abs(z_serial)), F.lit(1.0))))
    length = F.length("token")
    kept = [c for c in t.columns if not c.startswith("_")]
    return keep(t.select(
        *kept, F.when(F.col("_e") == 0, 0).when(F.col("_e") <= 2, 1).otherwise(2).alias("family"),
        F.when(length < 32, 0).when(length < 48, 1).when(length < 80, 2).otherwise(3).alias("class"), F.cbrt(fisher).alias("score"),
    ), "token-scores")


def ordinary_tokens(spark: SparkSession, n: int = 24_000) -> DataFrame:
    """(token): `n` ordinary tokens of 20 to 109 characters, each told by its number: words joined in the styles of slugs, identifiers,
    constants and paths, with numbers or without, dates and times, counters, and repeated blocks."""
    pick = lambda *of: f"pmod(xxhash64({', '.join(map(str, of))}), {{}})"
    word = f"split('{WORDS}', ' ')[cast({pick('id', 'i').format(len(WORDS.split()))} AS int)]"
    rows = spark.range(n).withColumn("size", F.expr(f"cast(20 + {pick('id', 901).format(90)} AS int)")).withColumn("style", F.expr(f"cast({pick('id', 902).format(12)} AS int)"))
    rows = rows.withColumn("words", F.expr(f"transform(sequence(1, 40), i -> {word})")).withColumn("number", F.expr(f"cast({pick('id', 903).format(10_000)} AS string)"))
    day = "concat(2000 + pmod(xxhash64(id, {0}), 27), lpad(1 + pmod(xxhash64(id, {0}, 1), 12), 2, '0'), lpad(1 + pmod(xxhash64(id, {0}, 2), 28), 2, '0'), lpad(pmod(xxhash64(id, {0}, 3), 24), 2, '0'), lpad(pmod(xxhash64(id, {0}, 4), 60), 2, '0'))".format
    camel = "array_join(transform(words, w -> initcap(w)), '')"
    made = (
        "CASE style WHEN 0 THEN array_join(words, '-') WHEN 1 THEN array_join(words, '_') "
        f"WHEN 2 THEN {camel} WHEN 3 THEN array_join(words, '/') WHEN 4 THEN upper(array_join(words, '_')) "
        "WHEN 5 THEN array_join(transform(words, (w, i) -> if(i % 3 = 1, number, w)), '-') "
        f"WHEN 6 THEN concat(lower(substr({camel}, 1, 1)), substr({camel}, 2, size - 1 - length(number)), number) WHEN 7 THEN array_join(words, '') "
        "WHEN 8 THEN concat(substr(array_join(words, '-'), 1, size - 1 - length(number)), '-', number) "
        f"WHEN 9 THEN concat({', '.join(day(k) for k in range(911, 921))}) "
        "WHEN 10 THEN lpad(if(id % 2 = 0, cast(id AS string), lower(hex(id))), size, '0') "
        "ELSE repeat(substr(if(id % 2 = 0, sha2(cast(id AS string), 256), '0123456789abcdef'), 1, cast(1 + pmod(xxhash64(id, 904), 8) AS int)), 110) END"
    )
    return rows.select(F.expr(f"substr({made}, 1, size)").alias("token"))


def discoveries(tested: DataFrame, rate: float) -> DataFrame:
    """Tokens that are random by a Benjamini-Hochberg test in each class of lengths, with p, the chance that an ordinary one looks as random.

    The hypothesis is that a token is ordinary; what that looks like is told by ordinary_tokens() of its family and class, whose scores
    are nearly normal. The step-up rule at `rate` then reports so many that at most this share of the reported ones is expected to be
    ordinary: in short tokens, where the tests tell little, it reports few. Ranks come from counts in bins of the logarithm of p, a fixed
    number for each class, so no class is sorted in one task.
    """
    law = randomness(ordinary_tokens(tested.sparkSession)).groupBy("family", "class").agg(F.avg("score").alias("_at"), F.stddev("score").alias("_wide"))  # twelve rows
    t = tested.join(F.broadcast(law), ["family", "class"], "left").withColumn("p", _tail((F.col("_at") - F.col("score")) / F.greatest("_wide", F.lit(0.25)))).drop("_at", "_wide")
    t = keep(t.withColumn("_bin", F.least(F.floor(-BINS * F.log10("p")), F.lit(BINS * DEEPEST)).cast("int")), "secret-chances")
    bins = t.groupBy("class", "_bin").agg(F.count("*").alias("n"))
    down = Window.partitionBy("class").orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("m", F.sum("n").over(Window.partitionBy("class"))).withColumn("rank", F.sum("n").over(down))
    passed = F.pow(F.lit(10.0), -F.col("_bin") / BINS) <= rate * F.col("rank") / F.col("m")
    cut = bins.groupBy("class").agg(F.min(F.when(passed, F.col("_bin"))).alias("_cut"))  # four rows at most
    return t.join(F.broadcast(cut), "class").filter("_bin >= _cut").drop("_bin", "_cut")


def secrets(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base, spans for every row of docs(doc_id, text), spans as kind:start:end in code points.

    The fixed patterns and the tokens that the tests find random (kind random; of these a share of `rate` at most is expected to be
    ordinary) come from one scan over whole texts; only the matches are shuffled and kept, never a text. Null texts count as empty; repeated rows are scanned each for themselves.
    """
    found = keep(found_tokens(docs), "secret-hits")
    random = discoveries(randomness(found.filter("kind = 'random'")), rate).select("row", "doc_id", "kind", "start", "end")
    spans = found.filter("kind IS NULL OR kind <> 'random'").select("row", "doc_id", "kind", "start", "end")
    spans = spans.union(random).union(found.select("row", "doc_id", F.lit(None), F.lit(None), F.lit(None)))
    at = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    of = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    rows = spans.groupBy("row", "doc_id").agg(
        *(of(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", at.alias("at"), "kind", "end")))).alias("s"),
    )
    joined = "array_join(transform({}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.expr(joined.format("filter(s, x -> x.kind <> 'random')")).alias("base"), F.expr(joined.format("s")).alias("spans"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


QUERIES = {"op10_secrets": op10_secrets}
ORACLE: dict[str, str] = {}
