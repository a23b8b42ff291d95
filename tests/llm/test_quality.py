import math
import random
import re

from quillspan.llm import license as licenses
from quillspan.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    hit = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def histograms(text):
    rest, chars = text or "", []
    for p in quality.CLASSES:
        left = re.sub(p, "", rest)
        chars.append(len(rest) - len(left))
        rest = left
    low = [w.lower() for w in WORD.findall(text or "")]
    vocab = [low.count(c) for c in quality.COMMON]
    return [*chars, len(rest)], [*vocab, len(low) - sum(vocab)]


def js(p, q):
    if not sum(p) or not sum(q):
        return 0.0
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    kl = sum(x * math.log2(2 * x / (x + y)) for x, y in zip(p, q) if x) + sum(y * math.log2(2 * y / (x + y)) for x, y in zip(p, q) if y)
    return math.sqrt(max(0, kl / 2))


def rows():
    r = random.Random(8)
    word = lambda: r.choice(["the", "of", "Der", "und,", "été", "x", "12", "a!!", "##", "para"] + ["w%d" % r.randrange(40)] * 4)
    out = [(1, None, "en"), (2, "", None), (3, " \n\t\x0b", "en"), (4, "a " * 100, "en"), (5, "x y z\nx y z\n\n\nx y z", "fr"), (6, "#" * 400, "en")]
    for k in range(10, 120):
        text = "".join(word() + r.choice([" ", " ", "\n", "  ", "\r\n"]) for _ in range(r.randint(0, 260)))
        if r.random() < 0.3:
            text += " " + text[: len(text) // 2]
        if r.random() < 0.2:
            text = text.upper() + " && $$ " * 60
        out.append((k, text, r.choice(["en", "de", None])))
    return [*out, out[9], (None, out[8][1], "en")]


def test_against_brute_force(spark):
    data = rows()
    docs = spark.createDataFrame([(*x, 1) for x in data], "doc_id long, text string, lang string, key int").repartition(3)
    refs = {}
    for _, t, lang in data:
        a, b = refs.setdefault(lang or "", ([0] * 8, [0] * (len(quality.COMMON) + 1)))
        for total, own in zip((a, b), histograms(t)):
            for i, v in enumerate(own):
                total[i] += v
    want = []
    for k, t, lang in data:
        n, *rest = base(t)
        (chars, vocab), (rc, rv) = histograms(t), refs[lang or ""]
        failed = n < 20 or 100 * rest[3] > 30 * n
        far = sum(chars) >= quality.MIN_CHARS and js(chars, rc) > quality.MAX_CHAR_DISTANCE
        far = far or (n >= quality.MIN_WORDS and js(vocab, rv) > quality.MAX_WORD_DISTANCE + quality.WORD_NOISE / math.sqrt(n))
        want.append((k, n, *rest, failed, not failed and not far))
    got = quality.judge_quality(docs).drop("char_distance", "word_distance").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {x[-1] for x in want} == {True, False}
    assert quality.judge_quality(docs.limit(0)).count() == 0
