import random
import re

import xxhash
from flowlens.llm import line_dedup as L
from pyspark.sql import functions as F

BETWEEN = re.compile(r"\n|(?<=[.!?,;:]) |(?<=[。！？，；：])(?!\n)")
CUT = re.compile(r"(?<=\n)|(?<=[.!?,;:] )|(?<=[。！？，；：])(?!\n)")


def spark_hash(values):
    """The built-in 64-bit hash of longs, one seeding the next."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest((v % 2**64).to_bytes(8, "little"), seed)
    return seed - 2**64 if seed >> 63 else seed


def chunks(own):
    """(first, size) of the chunks of a list of units."""
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in own]
    rolled = [spark_hash([hashes[i], *([hashes[i - 1]] if i else [])]) for i in range(len(own))]
    out, first = [], 0
    for i in range(len(own)):
        if i == len(own) - 1 or i and rolled[i] < rolled[i - 1] and rolled[i] <= rolled[i + 1]:
            out.append((first, i + 1 - first))
            first = i + 1
    return out


def brute(rows):
    order = sorted({(i is not None, i or 0, t or "") for i, t in rows}, key=lambda x: x[:2])
    raw = {k: CUT.split(k[2]) for k in order}
    own = {k: BETWEEN.split(k[2]) for k in order}
    assert all(len(own[k]) == len(raw[k]) for k in order)
    cut = {k: chunks(own[k]) for k in order}
    first, gone = {}, {k: set() for k in order}
    for k in order:
        for c, (a, n) in enumerate(cut[k]):
            run = tuple(own[k][a:a + n])
            if n < 2 or not any(u.strip() for u in run):
                continue
            kept, b = first.setdefault(run, (k, c))
            if (kept, b) == (k, c):
                continue
            (a2, _), x, y = cut[kept][b], own[k], own[kept]
            low, high, high2 = cut[k][c - 1][0] if c else a, a + n, a2 + n
            low2 = cut[kept][b - 1][0] if b else a2
            top = sum(cut[k][c + 1]) if c + 1 < len(cut[k]) else high
            top2 = sum(cut[kept][b + 1]) if b + 1 < len(cut[kept]) else high2
            while a > low and a2 > low2 and x[a - 1] == y[a2 - 1]:
                a, a2 = a - 1, a2 - 1
            while high < top and high2 < top2 and x[high] == y[high2]:
                high, high2 = high + 1, high2 + 1
            gone[k].update(range(a, high))
    out = []
    for i, t in rows:
        k = (i is not None, i or 0, t or "")
        text, lost, run = "", 0, []
        for j, u in enumerate([*raw[k], ""]):
            if j in gone[k]:
                run.append(u)
                continue
            said = "".join(run)
            if len(said.split()) >= 30 or said.count("\n") >= 2:
                lost += len(run)
            else:
                text += said
            text, run = text + u, []
        out.append((i, k[2].count("\n") + 1, lost, text))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_lines"], r["removed_units"], r["clean_text"]) for r in L.deduplicated(df).collect()), key=str)


def test_documents(docs, texts):
    assert got(docs) == brute(texts)


def test_edges(edge, clash, empty, edge_rows):
    assert got(edge) == brute([r[:2] for r in edge_rows]) == got(clash)
    assert got(empty) == []


def said(rng, words):
    out = [rng.choice("abcdefghij") + str(rng.randrange(10**6)) + rng.choice(("", "", "", "", ",", ".")) for _ in range(words)]
    return " ".join(out) + "."


def test_passages_of_fifty_words_are_found(spark):
    """Recall on passages over 50 words planted as lines, several lines, and inside lines; other texts lose nothing."""
    rng = random.Random(5)
    passages = [said(rng, rng.randint(52, 90)) for _ in range(30)] + ["\n".join(said(rng, 20) for _ in range(3)) for _ in range(30)]
    rows, held = [], {}
    for d in range(600):
        own = [said(rng, rng.randint(3, 40)) for _ in range(6)]
        if d % 2:
            p = passages[d // 2 % 60]
            k = rng.randrange(6)
            own[k] = p if d % 4 == 1 or "\n" in p else own[k] + " " + p + " " + said(rng, 9)
            held[d] = p
        rows.append((d, "\n".join(own)))
    out = got(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out == brute(rows)
    clean = {i: t for i, _, _, t in out}
    first = {}
    later = [d for d, p in sorted(held.items()) if first.setdefault(p, d) != d]
    lost = {d: len(dict(rows)[d].split()) - len(clean[d].split()) for d in range(600)}
    assert sum(lost[d] >= 0.9 * len(held[d].split()) for d in later) >= 0.9 * len(later)
    assert all(lost[d] == 0 for d in range(600) if d not in later)
    assert all(lost[d] <= len(held[d].split()) for d in later)


def test_shifted_passages(spark):
    """A run of lines is found again wherever it stands, up to its ends but for a unit or two."""
    passage = [f"The shared line number {i} of a passage." for i in range(40)]
    rows = [(d, "\n".join([f"own {d} {i}" for i in range(d % 7 + 1)] + passage + [f"end {d} {i}" for i in range(3)])) for d in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = L.deduplicated(df).collect()
    assert got(df) == brute(rows)
    assert all(38 <= r["removed_units"] <= 40 for r in out if r["doc_id"])
    assert next(r["removed_units"] for r in out if r["doc_id"] == 0) == 0


def test_every_unit_stays_somewhere(spark):
    """Whatever repeats, also within a text, one copy of each unit is left."""
    rng = random.Random(2)
    rows = [(d, "\n".join(rng.choice("ABCDEF") * 3 for _ in range(40))) for d in range(60)]
    out = got(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out == brute(rows)
    assert {u for _, t in rows for u in t.split("\n")} == {u for *_, t in out for u in t.split("\n") if u}
    assert sum(n for _, _, n, _ in out) > 100


def test_scripts_without_blanks(spark):
    rng = random.Random(8)
    said = lambda: "".join("".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(8)) + rng.choice("。，！") for _ in range(9))
    shared = said() + "\n" + said() + "\n"
    rows = [(d, said() + shared + said()) for d in range(20)]
    out = got(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out == brute(rows) and sum(n for _, _, n, _ in out) >= 19 * 16


def test_few_words_stay(spark):
    df = spark.createDataFrame([(1, "one, two, three, four, and own"), (2, "one, two, three, four, or other"), (3, "x\ny")], "doc_id long, text string").withColumn("spans", F.lit(1))
    assert {r["clean_text"] for r in L.deduplicated(df).collect()} == {r["text"] for r in df.collect()}
