"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of character classes and its histogram of common words are compared with those of its
language by Jensen-Shannon distance. The language's own histograms are sums over all documents of that language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.words import words
from quillspan.session import scratch

#: Character classes, each a Java and RE2 pattern; a character counts for the first class that has it.
CLASSES = [r"[a-z]+", r"[\x20\x09-\x0D]+", r"[^\x00-\x7F]+", r"[A-Z]+", r"[0-9]+", r"[#*$%&|<>]+", r"[!?]+"]
#: Frequent function words of English, French, German and Spanish; any other word is one more class.
COMMON = (
    "the of and to in is that for it as with was on are be this "
    "le la les de des et en un une du que pour par au dans est "
    "der die das und von zu mit den dem ein eine auf ist nicht sich für "
    "el los las del y por con una se no al lo para como más"
).split()
#: Shorter texts are not judged by the histogram in question.
MIN_WORDS, MIN_CHARS = 100, 300
MAX_CHAR_DISTANCE = 0.30
#: The word limit is the first number plus the second over the root of the words: a short text's histogram is noisy.
MAX_WORD_DISTANCE, WORD_NOISE = 0.12, 2.4
REPEAT_WINDOW = 8
#: Up to so many languages, their references are broadcast; beyond, they are joined by a shuffle.
BROADCAST_LANGUAGES = 10_000


def with_repeats(df: DataFrame, words_column: str, width: int, name: str) -> DataFrame:
    """Add ``name``: how many words lie in a window of ``width`` words that the text has twice or more.

    Windows are compared by a 64-bit hash of their words. Sorting (hash, start) brings equal windows together and
    sorting the starts found gives what they cover, so the work is n log n in the words of a text.
    """
    w, k = words_column, width
    df = df.withColumn("_h", F.expr(f"if(size({w}) >= {k}, transform(sequence(1, size({w}) - {k - 1}), i -> xxhash64(slice({w}, i, {k}))), array())"))
    df = df.withColumn("_s", F.expr("if(size(array_distinct(_h)) < size(_h), sort_array(transform(_h, (x, i) -> struct(x AS h, i AS i))), array())"))
    df = df.withColumn("_p", F.expr("sort_array(transform(filter(transform(_s, (e, k) -> struct(e.i AS i, (k > 0 AND _s[greatest(k - 1, 0)].h = e.h) OR (k < size(_s) - 1 AND _s[least(k + 1, size(_s) - 1)].h = e.h) AS d)), e -> e.d), e -> e.i))"))
    covered = f"aggregate(_p, struct(0L AS n, -{k} AS last), (a, x) -> struct(a.n + least({k}, x - a.last) AS n, x AS last)).n"
    return df.withColumn(name, F.expr(covered)).drop("_h", "_s", "_p")


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """A narrow row for each document: key, language, base counts, and both histograms as arrays of longs."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(F.col(key).alias("key"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), body.alias("body"))
    df = df.withColumns({"w": words("body"), "lines": F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), "rest0": F.col("body")})
    for i, pattern in enumerate(CLASSES):
        df = df.withColumn(f"rest{i + 1}", F.regexp_replace(f"rest{i}", pattern, ""))
    left = [F.char_length(f"rest{i}").cast("long") for i in range(len(CLASSES) + 1)]
    hist = [left[i] - left[i + 1] for i in range(len(CLASSES))] + [left[-1]]
    df = df.withColumns({
        "n_words": F.size("w").cast("long"),
        "word_chars": left[0] - hist[1],
        "n_symbols": hist[5],
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "chars": F.array(*hist),
        "low": F.split(F.lower(F.array_join("w", " ")), " "),
    })
    df = with_repeats(df, "w", REPEAT_WINDOW, "n_repeat_words")
    some = ", ".join(f"'{x}'" for x in COMMON)
    df = df.withColumn("common", F.expr(f"concat(' ', array_join(filter(low, x -> x IN ({some})), '  '), ' ')"))
    size = F.octet_length("common")
    counts = [((size - F.octet_length(F.replace("common", F.lit(f" {x} "), F.lit("")))) / F.lit(len(x.encode()) + 2)).cast("long") for x in COMMON]
    df = df.withColumn("known", F.array(*counts))
    df = df.withColumn("vocab", F.concat("known", F.array(F.col("n_words") - F.aggregate("known", F.lit(0).cast("long"), lambda a, x: a + x))))
    return df.select("key", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "vocab")


def language_references(rows: DataFrame) -> DataFrame:
    """One row for each language: the sums of both histograms over all its documents."""
    sums = lambda name, n: F.array(*[F.sum(F.col(name)[i]) for i in range(n)]).alias(f"ref_{name}")
    return rows.groupBy("lang").agg(sums("chars", len(CLASSES) + 1), sums("vocab", len(COMMON) + 1))


def js_distance(p: str, q: str) -> Column:
    """Square root of the Jensen-Shannon divergence, base 2, of two arrays of counts; 0 if either is empty."""
    share = lambda name: F.expr(f"transform({name}, x -> x / nullif(aggregate({name}, 0L, (a, y) -> a + y), 0))")
    part = lambda x, y: F.when((x > 0) & (y > 0), x * F.log2(2 * x / (x + y))).when(x > 0, x).otherwise(F.lit(0.0))
    both = F.zip_with(share(p), share(q), lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.coalesce(F.aggregate(both, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)) / 2))


def judge_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """Base counts, distances and verdict for each document; one row each, repeated keys included.

    kept is false if base_failed (under 20 words, or over 30 % of the words in repeated windows), or if the text has
    MIN_CHARS characters and its character classes are further than ``max_char`` from its language's, or has
    MIN_WORDS words and its common words are further than ``max_word`` + WORD_NOISE / sqrt(words). A null text counts as empty, a null language
    as the language "". Only the three named columns are read. An empty table gives an empty result.
    """
    rows = scratch(features(docs, key, text, lang), "quality")
    refs = scratch(language_references(rows), "references")
    refs = F.broadcast(refs) if refs.count() <= BROADCAST_LANGUAGES else refs
    df = rows.join(refs, "lang")
    df = df.withColumns({"char_distance": js_distance("chars", "ref_chars"), "word_distance": js_distance("vocab", "ref_vocab")})
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    total = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
    far = ((total >= MIN_CHARS) & (F.col("char_distance") > max_char)) | ((F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > max_word + WORD_NOISE / F.sqrt("n_words")))
    return df.select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("char_distance"), F.col("word_distance"), failed.alias("base_failed"), (~failed & ~far).alias("kept"))


def _sql() -> str:
    some = ", ".join(f"'{x}'" for x in COMMON)
    strip, columns = "body", []
    for pattern in CLASSES:
        strip = f"regexp_replace({strip}, '{pattern}', '', 'g')"
        columns.append(strip)
    left = ["length(body)", *[f"length({x})" for x in columns]]
    hist = ", ".join([f"{a} - {b}" for a, b in zip(left, left[1:])] + [left[-1]])
    known = ", ".join(f"count(*) FILTER (low = '{x}')" for x in COMMON)
    sums = lambda name, n: "[" + ", ".join(f"sum({name}[{i + 1}])" for i in range(n)) + "]"
    part = "CASE WHEN {x} > 0 AND {y} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) WHEN {x} > 0 THEN {x} ELSE 0 END"
    share = lambda a: f"list_transform({a}, lambda x: x::DOUBLE / nullif(list_sum({a}), 0)::DOUBLE)"
    both = part.format(x="z[1]", y="z[2]") + " + " + part.format(x="z[2]", y="z[1]")
    distance = lambda p, q: f"sqrt(greatest(0, coalesce(list_sum(list_transform(list_zip({share(p)}, {share(q)}), lambda z: {both})), 0) / 2))"
    return f"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS body FROM documents
), base AS (
  SELECT doc_id, lang, body, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, [{hist}] AS chars
  FROM docs
), word AS (
  SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM base
), windows AS (
  SELECT doc_id, i, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {REPEAT_WINDOW - 1} FOLLOWING) AS g,
         count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {REPEAT_WINDOW - 1} FOLLOWING) AS n
  FROM word
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows WHERE n = {REPEAT_WINDOW}) WHERE c > 1
), repeats AS (
  SELECT doc_id, sum(least({REPEAT_WINDOW}, gap)) AS n FROM (
    SELECT doc_id, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - {REPEAT_WINDOW}) AS gap FROM twice) GROUP BY doc_id
), known AS (
  SELECT doc_id, [{known}] AS known, count(*) AS n FROM (SELECT doc_id, lower(w) AS low FROM word) GROUP BY doc_id
), rows AS (
  SELECT b.doc_id, b.lang, coalesce(k.n, 0)::BIGINT AS n_words, (length(body) - chars[2])::BIGINT AS word_chars, chars[6]::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, chars,
         list_append(coalesce(known, list_transform(range({len(COMMON)}), lambda x: 0)), coalesce(k.n - list_sum(known), 0)) AS vocab
  FROM base b LEFT JOIN repeats r USING (doc_id) LEFT JOIN known k USING (doc_id)
), refs AS (
  SELECT lang, {sums("chars", len(CLASSES) + 1)} AS ref_chars, {sums("vocab", len(COMMON) + 1)} AS ref_vocab FROM rows GROUP BY lang
), far AS (
  SELECT rows.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         {distance("chars", "ref_chars")} AS dc, {distance("vocab", "ref_vocab")} AS dw
  FROM rows JOIN refs USING (lang)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (list_sum(chars) >= {MIN_CHARS} AND dc > {MAX_CHAR_DISTANCE})
       AND NOT (n_words >= {MIN_WORDS} AND dw > {MAX_WORD_DISTANCE} + {WORD_NOISE} / sqrt(n_words)) AS kept
FROM far
"""


OP2_SQL = _sql()


def op2(spark, sf_dir: str) -> DataFrame:
    """The query: the base counts and the verdict on every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge_quality(docs).drop("char_distance", "word_distance")
