"""The corpus operators on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; and against
brute force."""

import collections
import hashlib
import itertools
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vertexloom.llm import chat, components, exact_dedup, fingerprints, line_dedup, mixing, ngram_join, packing, queries, textscan, toxicity, url_filters, warc

DIR = "/root/testdata/sf0.001"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [(1, "Ab c"), (2, "aB C"), (3, None), (4, ""), (5, "É x"), (6, "é x"), (None, "ab c"), (7, LONG), (8, LONG + " more"), (8, LONG + " more"), (9, "  \n\n "), (10, "one two\nthree. Four!")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", None if i == 3 else "s", 0, 0.5, 7, "x") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, size long, kept string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.mark.parametrize("inline", [500, 0])
def test_url_filters(spark, inline):
    urls = ["http://A.example.COM/en/7x?q", "https://x.com/en/1", "http://example.net/de/8/", "http://b.net/de/8", "http://y.org/es/", "http://org/es", "://", None, "no scheme", "http://ads-track.example.com/x", "http://badexample.com/EN/7", "http://x.com/en/1"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge_urls(df, url_filters.HOST_RULES + url_filters.GLOBS, max_inline=inline).collect()}
    assert out[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert out[1] == ("x.com", "/en/1", "com/en/", "block") and out[11][2] == "com/en/"
    assert out[2][2:] == ("example.net/de/8", "block") and out[3][2:] == ("net/de/", "allow") and out[4][2:] == ("org/es/", "block")
    assert out[5][2:] == out[8][2:] == (None, "allow")
    assert out[6] == out[7] == ("", "", None, "allow")
    assert out[9][2:] == ("*ads-track.*", "block") and out[10][2] is None
    assert url_filters.judge_urls(df.where("false"), url_filters.HOST_RULES, max_inline=inline).count() == 0


def _chat_digests(rows):
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r, x or ""))
    return {c: (len(v), hashlib.sha256("".join(f"{r or ''}\n{x}\n" for _, r, x in sorted(v, key=lambda y: (y[0] is not None, y[0] or 0, y[1] is not None, y[1] or "", y[2]))).encode()).hexdigest()) for c, v in by.items()}


def test_chat(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\/s>", "<\\\\s>", "[+]", "[\\+]", "[:]", "\\", "a\\[INST]", " ", "", None, "<s", "[/ROLE] x [ROLE] "]
    rows = [(1, i, r, x) for i, (r, x) in enumerate(itertools.product(["user", "assistant", "system", "tool", None, "a[:]b"], nasty))]
    rows += [(2, 0, "assistant", "a"), (2, 1, "assistant", "</s>"), (None, None, "user", "x"), (1, 3, "user", "tie"), (1, 3, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.digests(chat.format_chats(df)).collect()}
    assert {c: (r["n_turns"], r["turns_sha256"]) for c, r in out.items()} == _chat_digests(rows)
    assert out[2]["loss_sha256"] == hashlib.sha256(b"a</s>").hexdigest() and out[2]["loss_chars"] == 5
    assert chat.format_chats(df.where("false")).count() == 0


def test_chat_merges(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(df).first()["formatted"] == "[INST] a[+]b [/INST]<s>c</s>"


@pytest.mark.parametrize("hashed", [exact_dedup.content_hash, lambda c: F.lit("same")])
def test_exact_dedup(odd, none, hashed):
    groups = collections.defaultdict(list)
    for i, t in ODD:
        groups[(t or "").translate(ASCII)].append(i)
    out = exact_dedup.exact_groups(odd, keep="largest", hashed=hashed).collect()
    assert len(out) == len(ODD)
    want = {hashlib.sha256(k.encode()).hexdigest(): (len(v), max((i for i in v if i is not None), default=None)) for k, v in groups.items()}
    assert all((r["group_size"], r["keep_id"]) == want[r["text_sha256"]] and r["kept"] == (r["doc_id"] == r["keep_id"]) for r in out)
    assert exact_dedup.exact_groups(none).count() == 0


def test_fingerprints(odd, none, documents):
    out = fingerprints.with_edits(documents).collect()
    rows = sorted((r["doc_id"], r["text"]) for r in documents.collect())
    following = {i: rows[(k + 1) % len(rows)][1] for k, (i, _) in enumerate(rows)}
    text = dict(rows)
    for r in out:
        t = text[r["doc_id"]]
        k = len(t) // 4
        edited = t[: len(t) - k] + following[r["doc_id"]][:k]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["near_edited"] == 1) == (edited == t) and (r["near_next"] == 1) == (t == following[r["doc_id"]])
        assert 0 <= r["near_edited"] <= 1
    assert len({r["fingerprint"] for r in out}) == len({text[r["doc_id"]] for r in out})
    assert np.mean([r["near_edited"] for r in out]) > 0.6 > 0.2 > np.mean([r["near_next"] for r in out])
    assert fingerprints.with_edits(odd).count() == len(ODD)
    assert fingerprints.with_edits(odd.where("doc_id = 1")).first()["near_next"] == 1
    assert fingerprints.with_edits(none).count() == 0


def test_differing(spark):
    df = spark.createDataFrame([("a b.\nc d.\n\ne f.", "a b.\nc x.\n\ne f.")], "a string, b string")
    assert df.select(fingerprints.differing(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("d")).first()["d"] == [1]


@pytest.mark.parametrize("seed", range(3))
def test_sainte_lague(spark, seed):
    rng = np.random.default_rng(seed)
    weights, seats = rng.integers(0, 50, 12).tolist(), int(rng.integers(0, 60))
    df = spark.createDataFrame([(f"k{i:02}", float(w), seats) for i, w in enumerate(weights)], "key string, w double, seats long")
    got = {r["key"]: r["quota"] for r in mixing.sainte_lague(df, "w", "seats", "key", []).collect()}
    quotients = sorted(((-w / (2 * k + 1), f"k{i:02}", k) for i, w in enumerate(weights) if w for k in range(seats)))[:seats]
    assert got == {f"k{i:02}": sum(q[1] == f"k{i:02}" for q in quotients) for i in range(12)}


def test_mixing(spark, odd, none, documents):
    out = mixing.mix(documents.select("doc_id", "text", "source")).collect()
    sources = collections.Counter()
    for r in out:
        sources[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    assert all(abs(sources[r["source"]] - r["target"]) <= mixing.BLOCK_WORDS for r in out)
    made = mixing.materialised(mixing.mix(documents))
    assert made.columns == documents.columns
    assert sum(len((r["text"] or "").split()) for r in made.collect()) == sum(sources.values())
    got = mixing.mix(odd)
    assert got.count() == len(ODD) and "lang" in got.columns
    assert mixing.mix(none).count() == 0


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in links)}


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def _brute_components(rows):
    sets = [(i, _shingles(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, (_, x)), (b, (_, y)) in itertools.combinations(enumerate(sets), 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    ids = collections.defaultdict(list)
    for k, (i, _) in enumerate(sets):
        ids[find(k)].append(i)
    return sorted(((i, len(s), min((x for x in ids[find(k)] if x is not None), default=None)) for k, (i, s) in enumerate(sets)), key=str)


def test_jaccard_join(odd, none, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = ngram_join.jaccard_components(documents).collect()
    assert sorted(map(tuple, got), key=str) == _brute_components(rows)
    assert sorted(map(tuple, ngram_join.jaccard_components(odd).collect()), key=str) == _brute_components(ODD)
    assert ngram_join.jaccard_components(none).count() == 0


def test_jaccard_join_of_near_copies(spark):
    """Copies each with words of their own, in chains whose ends are not similar; links across lists that their heads miss."""
    rng, rows = np.random.default_rng(5), []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(60)]
        for k in range(25):
            words = list(base)
            for i in rng.integers(0, 60, rng.integers(0, 4)):
                words[i] = f"x{rng.integers(0, 10_000)}"
            rows.append((len(rows), " ".join(words[: 60 - int(rng.integers(0, 12))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.jaccard_components(df).collect()), key=str) == _brute_components(rows)


def test_long_text_is_scanned_in_pieces(monkeypatch):
    import pyarrow as pa

    whole = [s.tolist() for s in textscan.shingle_sets(pa.array([LONG, "a b", None]))]
    monkeypatch.setattr(textscan, "GROUP", 1000)
    assert [s.tolist() for s in textscan.shingle_sets(pa.array([LONG, "a b", None]))] == whole


def test_line_dedup(spark, odd, none):
    base = "the quick brown fox jumps over the lazy dog and runs far away from every single house in town today"
    rows = [(1, f"{base}\nshort line\nanother line that stands only here once for all"), (2, f"  {base.upper()} \nshort line"), (3, base.replace("lazy", "sleepy") + "\n" + base), (4, None), (None, base)]
    rows += [(5, "no two lines of this one are like any other at all\nno two words here match those above us")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert out[None]["text"] == base  # null ids come first
    assert out[1]["text"] == "short line\nanother line that stands only here once for all" and out[2]["text"] == "short line"
    assert base not in out[3]["text"] and out[4]["text"] is None and out[5]["n_kept"] == 2
    assert line_dedup.dedup_lines(odd).count() == len(ODD)
    assert line_dedup.dedup_lines(none).count() == 0


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("n_words", [40, 4000])
def test_line_dedup_finds_all_near_lines(spark, n_words):
    rng, lines = np.random.default_rng(n_words), []
    for n in [*range(5, 14), 16, 20, 31, 64, 70, 130]:
        for edits in (1, n // 8, n // 4, n // 4, n // 4 + 1):
            line = [f"w{i}" for i in rng.integers(0, n_words, n)]
            lines.append(line)
            changed = list(line)
            # Spread evenly, so that no run but the shortest is left, or anywhere: words replaced, put in, taken out.
            for j in range(edits):
                at = int((j + 1) * n / (edits + 1)) if rng.random() < 0.5 else int(rng.integers(0, len(changed)))
                at, kind = min(at, len(changed) - 1), rng.integers(0, 3)
                changed[at : at + (kind != 1)] = [f"new{rng.integers(0, 1000)}"] if kind < 2 else []
            lines.append(changed)
    lines = [x for x in lines if len(x) >= 5]
    root = list(range(len(lines)))
    near = [(i, j) for j in range(len(lines)) for i in range(j) if min(len(lines[i]), len(lines[j])) >= 0.75 * max(len(lines[i]), len(lines[j])) and _edits(lines[i], lines[j]) <= max(len(lines[i]), len(lines[j])) // 4]
    for i, j in near:
        low, high = sorted((root[i], root[j]))
        root = [low if r == high else r for r in root]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string")
    kept = {r["doc_id"] for r in line_dedup.dedup_lines(df).where("n_kept = 1").collect()}
    assert len(near) > 40 and kept == set(root)


def test_simhash(spark):
    words = [[f"w{i}" for i in range(n)] for n in (1, 2, 63, 64, 200)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w array<string>").withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    hashes = {r["i"]: r["h"] for r in df.collect()}
    for r in line_dedup.with_simhash(df, "h", "sig").collect():
        if len(hashes[r["i"]]) <= line_dedup.RUN:
            want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes[r["i"]]) > len(hashes[r["i"]]) // 2)
            assert r["sig"] % (1 << 64) == want


def _check_packing(rows, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer())
    t.encode_special_tokens = True
    ids = {k: np.array([*t.encode(v or "", add_special_tokens=False).ids, 0], "<u4") for k, v in texts.items()}
    placed, total = collections.defaultdict(list), collections.Counter()
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(own.tobytes()) == r["ids_crc32"] and 0 < r["length"] <= 2048
        assert r["piece"] == 0 or r["length"] == 2048
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
        total[r["doc_id"]] += r["length"]
    for own in placed.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    return total, ids, placed


def test_packing(documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    total, ids, placed = _check_packing(packing.pack(documents, queries.tokenizer()).collect(), texts)
    assert total == {k: len(v) for k, v in ids.items()}
    assert len(placed) == packing.lower_bound([x % 2048 or 2048 for x in total.values()] + [2048 for x in total.values() for _ in range((x - 1) // 2048)])


def test_packing_of_odd_texts(spark, odd, none):
    strange = ["a  b  c\n\n d\t\te", "x  y", "\u0085 q", "tab\x0bvt", "a  b", " lead", "trail ", "\n", "<|endoftext|> x", "é\n\n\nü ß", "don't  stop", LONG, None, ""]
    df = spark.createDataFrame(list(enumerate(strange)), "doc_id long, text string")
    total, ids, _ = _check_packing(packing.pack(df, queries.tokenizer()).collect(), dict(enumerate(strange)))
    assert total == {k: len(v) for k, v in ids.items()}
    assert packing.pack(odd, queries.tokenizer()).where("piece = 0").count() == len(ODD)
    assert packing.pack(none, queries.tokenizer()).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_bin_completion(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 21, rng.integers(1, 11)).tolist()

    def fewest(left, rooms):
        if not left:
            return len(rooms)
        x, best = left[0], 99
        for i in range(len(rooms)):
            if rooms[i] >= x:
                best = min(best, fewest(left[1:], rooms[:i] + [rooms[i] - x] + rooms[i + 1 :]))
        return min(best, fewest(left[1:], [*rooms, 20 - x])) if len(rooms) < 9 else best

    got = packing.complete(lengths, 20)
    assert sorted(x for b in got for x in b) == sorted(lengths) and all(sum(b) <= 20 for b in got)
    assert packing.lower_bound(lengths, 20) <= len(got) <= fewest(sorted(lengths, reverse=True), []) + 1
    assert len(got) <= len(packing.best_fit(lengths, 20))


def test_bin_completion_beats_best_fit():
    lengths = [6, 6, 5, 5, 4, 4]  # best fit leaves room in all; 6 + 4 twice and 5 + 5 fill three
    assert len(packing.complete(lengths, 10)) == 3


def test_bin_completion_tries_all_undominated_fillings():
    assert len(packing.complete([70, 69, 16, 15, 10, 10, 10], 100)) == 2  # 70 + 10 + 10 + 10
    rng = np.random.default_rng(0)
    for _ in range(40):
        cuts = [np.sort(rng.choice(np.arange(1, 2048), rng.integers(2, 4), replace=False)) for _ in range(4)]
        lengths = [int(x) for c in cuts for x in np.diff([0, *c, 2048])]
        got = packing.complete(lengths)
        assert len(got) == 4 and sorted(x for b in got for x in b) == sorted(lengths) and all(sum(b) <= 2048 for b in got)


def test_toxicity_gradient():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in toxicity._initial(rng).items()}
    net, x, at = toxicity.Network(w), rng.normal(size=(6, toxicity.DIM)), rng.integers(0, 6, (3, toxicity.WINDOW))
    both = net.projected(x)
    _, saved = net.run(both, at, keep=True)
    g, _ = net.gradients(x, both, at, saved, np.ones(3))
    for name in ("fx", "fh", "bh", "bc", "att", "att_v", "out"):
        i = tuple(rng.integers(0, k) for k in w[name].shape)
        old, side = w[name][i], []
        for step in (1e-3, -1e-3):
            w[name][i] = old + step
            side.append(float(net.run(net.projected(x), at).sum()))
        w[name][i] = old
        assert abs((side[0] - side[1]) / 2e-3 - g[name][i]) < 2e-2 * max(1, abs(g[name][i]))


def test_windows_cover_all():
    for n in (0, 1, 23, 24, 25, 40, 41, 500):
        rows = np.arange(1, n + 1)
        assert set(toxicity.windows_of(rows).ravel()) - {0} == set(rows)


@pytest.mark.parametrize("n", [64, 65, 96, 97, 128, 1000])
def test_toxicity_takes_all_of_long_words(n):
    word = "".join(chr(0x4E00 + i) for i in range(n))
    pieces = toxicity.tokens(f"a {word} b")[1:-1]
    assert all(len(x) <= 64 for x in pieces) and all(any(word[i : i + 32] in x for x in pieces) for i in range(n - 31))
    assert {g for i in range(n - 2) for g in toxicity.trigrams(word[i : i + 3])[1:2]} <= {g for x in pieces for g in toxicity.trigrams(x)}


def test_toxicity_behind_a_long_prefix():
    rng = np.random.default_rng(1)
    words = lambda bad: " ".join(["zqxkzqxk"] * 3 * bad + [f"word{i}" for i in rng.integers(0, 50, 20)])
    scorer = toxicity.Scorer(toxicity.train([(words(i % 2), i % 2) for i in range(200)]))
    clean, toxic = scorer.score(["_".join(["word1"] * 60), "_".join(["word1"] * 30 + ["zqxkzqxk"] * 20 + ["word1"] * 30)])
    assert toxic > clean + 0.2


def test_toxicity(spark, odd, none):
    d = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(documents, labels)
    out = toxicity.score(documents, model).join(labels, "doc_id").where(toxicity.held_out("doc_id")).select("score", "toxic").collect()
    assert np.mean([(r["score"] >= 0.5) == r["toxic"] for r in out]) > 0.93
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(odd, model).collect())
    assert toxicity.score(none, model).count() == 0
    assert {r["score"] for r in toxicity.score(odd, toxicity.fit(documents, labels.where("toxic = 0"))).collect()} == {0.0}


@pytest.mark.parametrize("roll", [1 << 20, 200])
def test_warc(spark, tmp_path, roll):
    same = "<p>é</p>" * 20
    rows = [(3, "http://a/é ?", same), (1, "http://b/", same), (2, None, "short"), (5, "http://c/", "short"), (4, "u", None), (None, "u", "x" * 150), (7, "u", ""), (1, "http://b/", same)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("shard", F.lit("clash"))
    files = [warc.write_warc(df, f"file://{tmp_path}/{k}", n_shards=n, roll_bytes=roll) for k, n in enumerate((3, 3))]
    assert files[0] == files[1]
    assert sorted(p.name for p in (tmp_path / "0").iterdir()) == sorted(["manifest.json", *[f["file"] for f in files[0]]])
    got = sorted(map(tuple, warc.read_warc(spark, f"file://{tmp_path}/0").collect()), key=str)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    again = lambda i, t: t == same and i != 1
    assert got == sorted(((i, u or "", len((t or "").encode()), sha(t), "revisit" if again(i, t) else "response", 1 if again(i, t) else None, None if again(i, t) else t or "") for i, u, t in rows), key=str)
    assert warc.write_warc(df.where("false"), f"file://{tmp_path}/none") == []


@pytest.mark.parametrize("name", ["op1_url_filters", "op2_warc", "op8_mixing", "op9_exact_dedup", "op10_chat_formatting"])
def test_against_sql(spark, name):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = entry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(*cols).collect()))) == sorted(map(str, want))


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    before = docs
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, before, DIR).cache()
        assert after.columns == docs.columns
        if name == "ngram_join":
            ids = [(i, c) for i, _, c in _brute_components([(r["doc_id"], r["text"]) for r in before.collect()])]
            assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for i, c in ids if i == c)
        elif name != "mixing":
            assert after.join(before, "doc_id", "left_anti").isEmpty() and after.count() > 0.5 * before.count()
        before = after
    rows = stage_rows = pipeline.STAGES[-1][1](spark, before, DIR).collect()
    assert stage_rows and sum(r["piece"] == 0 for r in rows) == before.count()


def test_short_lists_without_links_are_left_out():
    """Of a short list, rows that only the first may link with are no members; those that link past it are."""
    meta = lambda n, at: (n << 32) | at
    rows = [(1, 10, meta(20, 0)), (1, 11, meta(40, 0)), (1, 12, meta(80, 0)), (2, 20, meta(70, 0)), (2, 21, meta(80, 0)), (2, 22, meta(90, 0)), (2, 23, meta(300, 0)), (3, 30, meta(5, 0))]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["shingle", "set_id", "meta"])
    out = [r for b in ngram_join._lists(iter([batch])) for r in b.to_pylist()]
    assert {(r["a"], r["b"]) for r in out if r["b"] is not None} == {(20, 21), (20, 22)}
    assert [r["a"] for r in out if r["b"] is None] == [21, 22]


def test_parity_never_rules_out_a_link():
    """Bits that differ, the longer set's folded to the shorter's, are no more than shingles that differ; unlike large sets differ in many."""
    rng = np.random.default_rng(4)
    for n in (6, 500, 512, 700, 1100, 5000):
        own = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        near = np.unique(np.concatenate([own[: len(own) * 9 // 10], rng.integers(0, 1 << 63, n // 9).astype(np.uint64)]))
        other = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for x, likely in ((near, True), (other, False)):
            p, q = sorted((ngram_join._parity(own), ngram_join._parity(x)), key=len)
            folded = q if len(p) == len(q) else q[: len(p)] ^ q[len(p) :]
            apart = int(np.unpackbits((p ^ folded).view(np.uint8)).sum())
            assert apart <= len(np.setxor1d(own, x))
            assert (7 * (len(own) + len(x) - apart) >= 6 * (len(own) + len(x))) == likely
