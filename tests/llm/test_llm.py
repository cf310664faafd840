"""Every operator against brute force or a public library, with the defined odd cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plumbline.llm import (
    anomalies,
    attribution,
    byte_bpe,
    chat,
    chunks,
    circulant,
    hostrank,
    packing,
    quadratic,
    suffixes,
    topk,
)

PATH = public_tokenizers.path(attribution.VOCABULARY)
ODD = ["", " ", "a  b", " lead", "trail ", "x \n y", "\x1c a \x1c b", "  \n\n  z", "don't  'll",
       "\u3000 \u3000x <|endoftext|> y", "日本 語 é\u0301", "a\t b \tc", "1 22  333 \x85 q",
       "w" * 3000, "long " * 3000]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(90)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(6)]
    out = []
    for i in range(60):
        own = base[i % 6].split()
        for _ in range(i // 6 * 2):
            own[rng.randrange(len(own))] = rng.choice(words)
        out.append(("A " if i % 2 else "a ") + " ".join(own))
    return [*out, *ODD, base[0], base[0], None]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Extra columns with clashing names, a repeated row, a null text."""
    rows = [(i, text, 1, 2, 3) for i, text in enumerate(texts)]
    rows.append(rows[3])
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, node int, rank int, label int"
    ).repartition(3)


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def test_chat(spark):
    rows = [(1, 1, "assistant", "<|end|> &lt;"), (1, 0, "user", None), (2, 0, None, "x"),
            (2, 0, None, "x"), (None, 5, "assistant", "[INST]"), (3, 0, "a<b", "")]
    log = chat.conversation_log(
        spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    found = {r.conv_id: r for r in chat.conversation_digests(chat.format_log(log)).collect()}
    assert {k: r.n_turns for k, r in found.items()} == {1: 2, 2: 2, None: 1, 3: 1}
    said = "user\n\nassistant\n<|end|> &lt;\n"
    assert found[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert found[1].loss_sha256 == hashlib.sha256(b"<|end|> &lt;").hexdigest()
    events = [(1, 7, 0, 0, "delta", "user", "a"), (1, 7, 0, 1, "delta", "user", "b"),
              (1, 8, 1, 2, "delta", "assistant", "no"), (1, 8, 1, 3, "regenerate", "assistant", ""),
              (1, 8, 1, 4, "delta", "assistant", "yes"), (1, 7, 0, 5, "edit", "user", "c")]
    log = spark.createDataFrame(
        events, "conv_id bigint, message bigint, turn bigint, seq bigint, kind string, "
        "role string, text string")
    assert sorted((r.turn, r.text) for r in chat.fold_events(log).collect()) == [
        (0, "c"), (1, "yes")]
    assert chat.conversation_digests(chat.format_log(log.limit(0))).count() == 0


def test_token_counts(spark, docs, texts):
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(PATH)
    loaded.encode_special_tokens = True
    rows = attribution.token_counts(docs.distinct(), PATH).collect()
    total = Counter()
    for row in rows:
        total[row.doc_id] += row.n_tokens
    for i, text in enumerate(texts):
        assert total[i] == len(loaded.encode(text or "", add_special_tokens=False).ids), text
    # Tokens of one byte each, sections that leave a gap and cut a token of two bytes.
    counts, outside = attribution.attribute(
        np.array([1, 2, 1, 1]), np.array([0, 2, 4]), np.array([2, 4, 4]))
    assert counts.tolist() == [2, 1, 0] and outside == 1
    assert attribution.token_counts(empty(spark, docs.schema), PATH).count() == 0


def test_byte_bpe(docs, texts):
    import tiktoken

    path = public_tokenizers.path(byte_bpe.RANKS)
    ranks = byte_bpe.read_ranks(path)
    known = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                              special_tokens={})
    hashed = byte_bpe.PerfectHash.build(ranks)
    assert all(hashed.get(key) == number for key, number in ranks.items())
    assert hashed.get(b"no such token") is None
    for row in byte_bpe.round_trip(docs, path).collect():
        text = texts[row.doc_id] or ""
        ids = np.array(known.encode_ordinary(text), dtype="<u4").tobytes()
        assert row.ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_chunk_memory_is_bounded():
    # A worker has one encoder, whatever the number of its tasks.
    assert attribution.encoder(PATH) is attribution.encoder(PATH)
    loaded = attribution.encoder(PATH)
    memory = chunks.ChunkMemory(lambda chunk: repr(loaded.encode_ordinary(chunk)).encode(), 50)
    text = " ".join(["few", "w" * 100_000, *(f"w{i}" for i in range(120)), "few"])
    fresh = chunks.ChunkMemory(memory.encode)
    assert memory.code(text) == memory.code(text) == fresh.code(text)
    assert len(memory.codes) <= 50
    assert max(map(len, fresh.codes)) <= chunks.LONGEST


def test_packing(spark, docs):
    rows = packing.pack(docs, PATH, capacity=64).collect()
    bins: dict[int, list] = {}
    for row in rows:
        bins.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))]
        assert sum(n for _, n in held) <= 64
    assert len(bins) <= sum(r.length for r in rows) / 64 * 1.1 + 1
    blank = [r for r in rows if r.length == 1 and r.piece == 0]
    assert {r.ids_crc32 for r in blank} == {zlib.crc32(bytes(4))}
    # Greedy leaves 6 + 3; the 3 gives way to 2 + 2, which fill the bin.
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10)[0] == ([6, 2, 2], 1)
    assert packing.pack(empty(spark, docs.schema), PATH).count() == 0


def test_suffixes(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("ab") for _ in range(700))
    rows = [(i, base[rng.randrange(300):][: rng.randrange(250)] + "x" * rng.randrange(180)
             + base[rng.randrange(500):][:200]) for i in range(40)]
    rows += [(50, ""), (51, "y" * 99), (52, "é" * 400_000)]
    seen: set[bytes] = set()
    want = {}
    for key, text in rows:
        raw = text.encode()
        gone = bytearray(len(raw))
        for at in range(len(raw) - 99):
            string = raw[at : at + 100]
            if string in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.add(string)
        want[key] = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
    table = spark.createDataFrame([*rows, rows[1], (None, base), (60, None)],
                                  "doc_id bigint, text string").repartition(4)
    found = suffixes.remove_repeats(table).collect()
    assert len(found) == len(rows) + 3
    for row in found:
        if row.doc_id is None:
            assert row.kept == base.encode()
        else:
            assert row.kept == want.get(row.doc_id, b"")
    assert suffixes.remove_repeats(table.limit(0)).count() == 0


def test_suffixes_of_texts_under_one_doc_id(spark):
    """Texts that share a doc_id are documents of their own, in the order of their hashes."""
    rng = random.Random(4)

    def letters(n):
        return "".join(rng.choices("abcdefgh", k=n))

    shared = letters(300)
    rows = [(1, letters(868)), (1, letters(400) + shared + letters(90)),
            (1, shared + letters(700)), (2, letters(50) + shared), (2, letters(1148))]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows] + [(*rows[3], 1, 2)],
                                  "doc_id bigint, text string, doc int, runs int")
    marks = {r.text: r.mark for r in table.select("text", F.xxhash64("text").alias("mark")).collect()}
    seen: set[str] = set()
    want = {}
    for key, text in sorted(rows, key=lambda row: (row[0], marks[row[1]])):
        gone = [False] * len(text)
        for at in range(len(text) - 99):
            if text[at : at + 100] in seen:
                gone[at : at + 100] = [True] * 100
        seen |= {text[at : at + 100] for at in range(len(text) - 99)}
        want[(key, len(text))] = "".join(c for c, g in zip(text, gone, strict=True) if not g)
    found = suffixes.remove_repeats(table, ("doc", "runs")).collect()
    assert len(found) == 6
    for row in found:
        assert bytes(row.kept).decode() == want[(row.doc_id, row.n_bytes)]
    with pytest.raises(ValueError, match="other names"):
        suffixes.remove_repeats(table.withColumnRenamed("doc", "kept"), ("kept",))


def test_near_components(spark, docs, texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for text in texts:
        words = (text or "").translate(lower).encode().split()
        runs = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        sets.append(runs or ({tuple(words)} if words else set()))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, one in enumerate(sets):
        for j in range(i):
            if one and 100 * len(one & sets[j]) >= 75 * len(one | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    for row in circulant.near_components(docs).collect():
        assert row.n_shingles == len(sets[row.doc_id])
        assert row.component_id == find(row.doc_id)
        assert row.kept == (row.component_id == row.doc_id)
    assert circulant.near_components(docs.limit(0)).count() == 0


def test_alike_pair_whose_bytes_agree_in_a_band_it_does_not_share(spark):
    """Neither 2 nor 3 is first in the bucket; in band 0 their low bytes agree by chance."""
    signs = np.zeros((3, circulant.COORDINATES), dtype=np.uint8)
    signs[0] = 9
    bands = np.arange(3 * circulant.BANDS, dtype=np.int64).reshape(3, -1)
    bands[:, 5], bands[1:, 7] = 777, 888
    rows = [(n + 1, 10, bands[n].tolist(), signs[n].tobytes()) for n in range(3)]
    nodes = spark.createDataFrame(
        rows, "node bigint, n_shingles bigint, bands array<bigint>, bytes binary")
    opened = spark.createDataFrame(
        [(777, 5, n, n) for n in (1, 2, 3)] + [(888, 7, n, n) for n in (2, 3)],
        "band bigint, slot int, node bigint, part bigint")
    chosen = circulant.involved(circulant.block_pairs(opened), nodes)
    assert {r.node for r in chosen.collect()} == {2, 3}
    full = np.arange(10, dtype=np.uint64).tobytes()
    sets = spark.createDataFrame([(n, full) for n in (1, 2, 3)], "node bigint, shingles binary")
    found = circulant.forest(chosen, nodes, sets).collect()
    assert [tuple(r) for r in found] == [(2, 3)]


@pytest.mark.parametrize("block", [7, circulant.BLOCK])
def test_group_of_near_copies_larger_than_a_block(spark, monkeypatch, block):
    """Two clusters whose members are alike in pairs, hard to tell apart, against brute force;
    links stay fewer than members of the groups."""
    monkeypatch.setattr(circulant, "BLOCK", block)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(80)]
    texts = []
    for i in range(120):
        own = base[:]
        for _ in range(1 + i % 4):
            own[rng.randrange(80)] = f"n{i}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [set(s.tolist()) for s in circulant.shingle_sets(texts)]
    label = list(range(len(texts)))
    for i, one in enumerate(sets):
        for j in range(i):
            if 100 * len(one & sets[j]) >= 75 * len(one | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    found = {r.doc_id: r.component_id for r in circulant.near_components(docs).collect()}
    assert found == dict(enumerate(label))
    assert 3 < len(set(label)) < 100
    # Every member a component of its own: all pairs are looked at, a forest comes out.
    marked = circulant.marked(docs)
    nodes = circulant.stored(circulant.distinct_nodes(
        circulant.describe(marked, (circulant.MARK,))))
    opened = nodes.select(F.posexplode("bands").alias("slot", "band"), "node").select(
        "band", "slot", "node", F.col("node").alias("part"))
    several = opened.groupBy("band").count().filter("count > 1").select("band")
    dealt = circulant.block_pairs(opened.join(several, "band"))
    chosen = circulant.stored(circulant.involved(circulant.stored(dealt), nodes))
    links = circulant.forest(chosen, nodes, circulant.node_sets(marked, nodes)).collect()
    groups = chosen.select("band", "i", "j").distinct().count()
    assert 0 < len(links) <= chosen.count() - groups


def test_similar_pair_with_a_poor_estimate_is_confirmed(spark):
    """Three of four shingles in common, but only 320 of 512 coordinates."""
    sets = [np.arange(n, n + 7, dtype=np.uint64) for n in (0, 1)]
    signs = np.zeros((2, circulant.COORDINATES), dtype=np.uint8)
    signs[1, 320:] = 1
    nodes = spark.createDataFrame(
        [(n, 7, signs[n].tobytes()) for n in (0, 1)], "node bigint, n_shingles bigint, bytes binary")
    full = spark.createDataFrame(
        [(n, sets[n].tobytes()) for n in (0, 1)], "node bigint, shingles binary")
    pairs = spark.createDataFrame([(0, 1)], "a bigint, b bigint")
    assert [tuple(r) for r in circulant.confirm(pairs, nodes, full).collect()] == [(0, 1)]


def test_texts_without_or_under_one_doc_id_are_read_once(spark):
    rows = [(key, f"one two three four five{i} six{i}") for key in (None, 7) for i in range(20)]
    docs = circulant.marked(spark.createDataFrame(rows, "doc_id bigint, text string"))
    nodes = circulant.distinct_nodes(circulant.describe(docs, (circulant.MARK,)))
    assert circulant.node_texts(docs, nodes).count() == nodes.count() == 20
    assert circulant.node_sets(docs, nodes).count() == 20
    alone = circulant.distinct_nodes(
        circulant.describe(docs.filter("doc_id IS NULL"), (circulant.MARK,)))
    assert circulant.node_texts(docs, alone).count() == 20


def test_contract(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.label for r in circulant.contract(chain).collect()} == {0}


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 420)]
    rows += [(500, None), (501, [float("nan")] * 8), (502, [None] * 8), (550, [1.0, 2.0])]
    vectors = topk.quantised(
        spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    queries = vectors.filter("vec_id % 50 = 0")
    found = topk.top_k(vectors, queries, pivots=8, data_slice=50, query_slice=3).collect()
    whole_cell = topk.top_k(vectors, queries, pivots=1).collect()  # with the query itself
    whole = {i: np.floor(256 * np.array(v)) for i, v in rows[:420]}
    want = set()
    for q in range(0, 420, 50):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        want |= {(q, place + 1, i, -s) for place, (s, i) in enumerate(best)}
    assert {tuple(r) for r in found} == {tuple(r) for r in whole_cell} == want
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_vectors_are_copied_to_the_blocks_that_ask_for_their_cell(spark):
    data = spark.createDataFrame([(1, 8, 0), (2, 8, 1), (3, 8, 2)], "vec_id int, size int, cell int")
    routed = spark.createDataFrame(
        [(8, 0, 0), (8, 0, 0), (8, 1, 0), (8, 1, 1)], "size int, cell int, block int")
    found = sorted((r.vec_id, r.block) for r in topk.copied(data, routed).collect())
    assert found == [(1, 0), (2, 0), (2, 1)]


def test_forest_samples_are_the_smallest_draws(spark):
    rows = [(i, *[float((i * 7 + j * 3) % 11) for j in range(8)]) for i in range(900)]
    rows += [rows[5]] * 40 + [(None, *[float(j) for j in range(8)])] * 3  # repeated, no id
    schema = "doc_id bigint, " + ", ".join(f"{n} double" for n in anomalies.FEATURES)
    table = spark.createDataFrame(rows, schema).repartition(6)
    offered = anomalies.draw_samples(table, 4, 30).toPandas()
    assert len(offered) <= 6 * 4 * 30
    hashed = table.select(
        F.xxhash64("doc_id", *anomalies.FEATURES).alias("row"), *anomalies.FEATURES).toPandas()
    points = hashed[list(anomalies.FEATURES)].to_numpy()
    for tree in range(4):
        every = anomalies.draws(hashed["row"].to_numpy().view(np.uint64), tree)
        wanted = sorted(zip(every.tolist(), map(tuple, points.tolist())))[:30]
        mine = offered[offered["tree"] == tree]
        draw, kept = anomalies.smallest(
            mine["draw"].to_numpy().view(np.uint64),
            mine[list(anomalies.FEATURES)].to_numpy(), 30)
        assert sorted(zip(draw.tolist(), map(tuple, kept.tolist()))) == wanted
    both, again = anomalies.grow_forests(table, 4, 30), anomalies.grow_forests(
        table.repartition(3), 4, 30)
    assert [[tree[0] for tree in forest] for forest in both] == [[30] * 4] * 2
    for first, second in zip(both, again, strict=True):
        assert all((a == b).all() for x, y in zip(first, second) for a, b in zip(x[1:], y[1:]))
    assert anomalies.grow_forests(table.limit(0)) == [[], []]
    # Brute force of a whole score: the trees walked row by row, a group's columns alone.
    rules = table.select("*", *[F.lit(0).cast("bigint").alias(n) for n in anomalies.COUNTS],
                         F.lit(False).alias("base_failed"))
    rules = rules.withColumns({f"was_{n}": F.col(n) for n in anomalies.FEATURES})
    carried = tuple(f"was_{n}" for n in anomalies.FEATURES)
    for row in anomalies.score_rows(rules, both, carried).limit(20).collect():
        for name, columns, forest in zip(anomalies.SCORES, anomalies.GROUPS.values(), both):
            paths = [walk(tree, [row[f"was_{c}"] for c in columns]) for tree in forest]
            share = 2 ** (-np.mean(paths) / anomalies.average_path(30))
            assert abs(row[name] - 1000 * share) <= 1.001


def walk(tree, point):
    """The path length of one row in one tree."""
    _, feature, split, left, path = tree
    node = 0
    while feature[node] >= 0:
        node = left[node] + int(point[feature[node]] > split[node])
    return path[node]


def test_thresholds_by_brute_force():
    """Every threshold tried one by one on labelled scores, ties and missing classes included."""
    rng = np.random.default_rng(3)
    for share in (0.0, 0.01, 0.2):
        for good_rows, bad_rows in ((0, 0), (40, 0), (0, 40), (300, 40), (300, 300)):
            good, bad = rng.integers(300, 500, good_rows), rng.integers(350, 900, bad_rows)
            wanted = anomalies.BINS + 1
            for at in range(anomalies.BINS + 1, -1, -1):
                lost, caught = (good >= at).sum(), (bad >= at).sum()
                fits = lost <= share * max(good_rows, 1)
                if fits and caught * max(good_rows, 1) > lost * max(bad_rows, 1):
                    wanted = at
            size = anomalies.BINS + 2
            found = anomalies.lowest_fit(
                np.bincount(good, minlength=size), np.bincount(bad, minlength=size), share)
            assert found == wanted


def test_isolation_finds_the_far_rows():
    near = np.random.default_rng(1).normal(size=(256, 8))
    forest = []
    for seed in range(50):
        tree = anomalies.grow_tree(near, seed)
        forest.append((256, *map(np.array, tree)))
    scores = anomalies.anomaly_scores(forest, np.vstack([near, np.full((1, 8), 9.0)]))
    assert scores[-1] > scores[:-1].max()

    mean = np.mean([walk(tree, near[3]) for tree in forest])
    assert np.isclose(scores[3], 2 ** (-mean / anomalies.average_path(256)))


def test_quality_rules_refuses_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", 2)], "doc_id bigint, text string, words_score int")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert anomalies.quality_rules(docs, labels).count() == 1
    with pytest.raises(ValueError, match="words_score"):
        anomalies.quality_rules(docs, labels, ("words_score",))


def test_quality_rules(spark):
    assert anomalies.rule_counts("a a a a\nx|\nx|\n \n")[:5] == (6, 8, 2, 1, 4)
    rows = [(i, " ".join(f"word{(i * 7 + j) % 400}" for j in range(80))) for i in range(300)]
    rows += [(1000 + i, " ".join(f"#{i}|{j}$$" for j in range(80))) for i in range(3)]
    rows += [(2000, None), (2001, "short"), (2002, "a b c " * 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame(
        [(i, int(i < 1000)) for i, _ in rows[:303]] + [(2000, None)],
        "doc_id bigint, quality int")
    found = {r.doc_id: r for r in anomalies.quality_rules(docs, labels).collect()}
    assert all(found[i].base_failed and not found[i].kept for i in (2000, 2001, 2002))
    assert not any(found[1000 + i].kept for i in range(3))
    assert sum(found[i].kept for i in range(300)) >= 297
    free = anomalies.quality_rules(docs, labels.limit(0))
    assert free.filter("NOT base_failed AND NOT kept").count() == 0
    assert anomalies.quality_rules(docs.limit(0), labels).count() == 0


def test_quality_classifier(spark):
    good = [(i, " ".join(f"word{(i * 3 + j) % 50} of" for j in range(60))) for i in range(200)]
    bad = [(i + 200, " ".join(f"W{(i + j) % 50}!!" for j in range(60))) for i in range(60)]
    docs = spark.createDataFrame([*good, *bad, (900, None)], "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 200).cast("int").alias("quality"))
    found = quadratic.classify(docs, labels).collect()
    hits = [r.predicted == int(r.doc_id < 200) for r in found if r.held_out and r.doc_id < 900]
    assert sum(hits) >= 0.95 * len(hits)
    for row in found:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1)
        assert 0 <= row.score <= 1
    assert {r.score for r in quadratic.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_url_filters(spark):
    pages = [(1, "http://a.example.org/en/12?x", None), (2, "https://B.example.COM/de/1#t", ""),
             (3, None, ""), (4, "nothing", ""), (5, "http://org", ""), (6, "x://org/a", ""),
             (7, "http://farm.net/x", '<a href="https://b.example.com/de/1">'),
             (8, "http://fine.net/x", "<a href=/own>"), (8, "http://fine.net/x", None),
             (9, "http://b.example.com/en/2", '<a href="http://org/">')]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict)
             for r in hostrank.judge_pages(table).collect()}
    assert found[1] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert found[2] == ("b.example.com", "/de/1", "com/de/", "block")
    assert found[3] == found[4] == ("", "", None, "allow")
    assert found[5] == ("org", "", None, "allow")
    assert found[6] == ("org", "/a", "org/", "allow")
    assert found[7][3] == "block"  # links to a blocked host, and nobody trusted links to it
    assert found[8] == ("fine.net", "/x", None, "allow")
    assert found[9][3] == "block"
    assert hostrank.judge_pages(table.limit(0)).count() == 0


def test_links_name_a_host_by_scheme_or_two_slashes(spark):
    html = """<a href="//Two.net/x"><img src='HTTP://one.net?u=//no.net'><a href=/go?u=http://no.net>
    <a href="go://three.net"><a href=go?u=x://no.net><a href="/a//no.net">"""
    pages = spark.createDataFrame([("own.net", html)], "host string, html string")
    found = {tuple(r) for r in hostrank.host_edges(pages).collect()}
    assert found == {("own.net", f"{x}.net") for x in ("one", "two", "three")}


def test_distrust_reaches_hosts_behind_many_links_and_far_away(spark):
    """Four layers of 1,500 hosts that link to one of the layer before, and a chain of 40 hosts."""
    page = "x://{}.net/x"
    rows = [("x://b.com/de/1", "")]
    for layer, next_host in (("p", "b.com"), ("q", "p0.net"), ("r", "q0.net"), ("s", "r0.net")):
        rows += [(page.format(f"{layer}{i}"), f'<a href="x://{next_host}/">') for i in range(1500)]
    rows += [(page.format(f"c{i}"), f'<a href="x://{f"c{i - 1}.net" if i else "b.com"}/">')
             for i in range(40)]
    table = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(rows)], "page_id bigint, url string, html string")
    found = hostrank.judge_pages(table).filter("verdict <> 'block'").select("host")
    assert [r.host for r in found.collect()] == []
