"""Text operators against brute force, their SQL twins, and the odd cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import chat, exact, license, mix, near, pack, queries, repeats, rules, shards, toxic

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, id string"
ODD = [
    (1, None, None, None, None, "x", "a"), (2, "", "en", "src1", 0, "x", "a"),
    (3, "Alpha beta\tgamma delta epsilon zeta", "en", "src1", 5, None, None),
    (3, "Alpha beta\tgamma delta epsilon zeta", "en", "src1", 5, None, None),
    (4, "Alpha beta gamma delta epsilon zeta ", "de", "src2", 5, "x", "b"),
    (None, "alpha BETA gamma delta epsilon zeta", "de", None, 5, "x", "b"),
    (5, "word " * 30_000, "fr", "src3", 5, "y", "c"),
    (6, "né \U0001f600 " * 12 + "Released under the MIT License. You idiot!", "en", "src4", 1, "", ""),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def plain(frame):
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted(map(str, frame[sorted(frame.columns)].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.sql(queries.ORACLES[name]).df()
    for c in ("first_word", "last_word", "parent_conv_id"):
        if c in got:
            got[c], want[c] = got[c].astype("Int64"), want[c].astype("Int64")
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def near_groups(texts, percent=85):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_brute_force(spark, docs, texts):
    got = near.near_components(docs, near.Near(block=4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_groups(texts)


def test_near_group_of_edits(spark):
    """A chain of edits: neighbours are linked, the ends are not."""
    words = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join(words[: 119 - k] + [f"x{j}" for j in range(k)])) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near.near_components(df, near.Near(block=8)).collect()
    assert {r.component_id for r in got} == {i for _, i in near_groups(dict(rows)).values()}


def brute_repeats(rows, width=50):
    owner, out = {}, []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        mask = bytearray(len(data))
        for p in range(len(data) - width + 1):
            first = owner.setdefault(data[p:p + width], i)
            if first != i:
                mask[p:p + width] = b"\1" * width
        kept = bytes(b for b, m in zip(data, mask) if not m)
        out.append((i, len(data), sum(mask), len(re.findall(b"\1+", bytes(mask))),
                    hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_over_many_blocks(spark, docs, texts):
    rule = repeats.Repeats(block_bytes=20_000, part_bytes=15_000)
    got = repeats.remove_repeats(docs, rule).drop("spans").collect()
    assert sorted(map(tuple, got)) == sorted(brute_repeats(list(texts.items())))


def test_repeats_odd(spark, odd):
    got = repeats.remove_repeats(odd).drop("spans").collect()
    want = brute_repeats([(r[0], r[1]) for r in ODD])
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def naive_fit(items, capacity):
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(b[0], k) for k, b in enumerate(bins) if b[0] >= size and source not in b[1]
                and cluster not in b[2]]
        if fits:
            k = min(fits)[1]
        else:
            bins.append([capacity, set(), set()])
            k = len(bins) - 1
        out.append((k, capacity - bins[k][0]))
        bins[k][0] -= size
        bins[k][1].add(source)
        bins[k][2].add(cluster)
    return out


def check_bins(rows, sizes, source, cluster, capacity):
    filled, seen = defaultdict(int), set()
    pieces = defaultdict(int)
    for r in rows:
        filled[r.bin_id] += r.piece_size
        pieces[r.id] += r.piece_size
        for kind, value in (("s", source[r.id]), ("c", cluster[r.id])):
            if value is not None:
                assert (r.bin_id, kind, value) not in seen
                seen.add((r.bin_id, kind, value))
    assert max(filled.values()) <= capacity
    assert pieces == sizes


def test_packing(spark, docs, texts):
    rows = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t)), f"s{i % 5}", t[:40]) for i, t in
            texts.items()]
    df = spark.createDataFrame(rows, "id long, size long, source string, cluster string")
    got = pack.pack(df, 500, "id", "size", "source", "cluster", per_task=50).collect()
    check_bins(got, {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows},
               {r[0]: r[3] for r in rows}, 500)
    items = sorted(((r[1] % 500, int(r[2][1:]), hash(r[3]) % 40) for r in rows), reverse=True)
    assert pack.best_fit(*map(list, zip(*items)), 500) == naive_fit(items, 500)


def test_shards_minimal(spark, docs, texts):
    got = shards.shard(docs, 7, probes=50).collect()
    groups, order = defaultdict(int), {}
    for i, t in sorted(texts.items()):
        groups[t] += len(t.encode()) + 1
        order.setdefault(t, i)
    sizes = [groups[t] for t in sorted(groups, key=order.get)]

    def fits(capacity):
        used, at = 1, 0
        for s in sizes:
            if s > capacity:
                return False
            used, at = (used + 1, s) if at + s > capacity else (used, at + s)
        return used <= 7
    best = next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))
    total, by_text = defaultdict(int), {}
    for r in got:
        total[r.shard] += r.size
        assert r.size == len(texts[r.doc_id].encode()) + 1
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert by_text.setdefault(texts[r.doc_id], r.shard) == r.shard
    assert max(total.values()) == best
    for s in total:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(
            sum(r.shard == s for r in got)))


def test_toxic_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxic.score(docs.join(labels.select("doc_id"), "doc_id"), toxic.train(docs, labels))
    rows = got.filter("held_out").join(labels, "doc_id").collect()
    hit = sum(r.predicted == 1 == r.toxic for r in rows)
    assert hit >= 0.9 * sum(r.toxic for r in rows)
    assert hit >= 0.8 * sum(r.predicted for r in rows)


def test_grammar_clauses():
    g = toxic.Grammar({"idiot": 4.0}, {"lowei": 4.0})
    assert g.clause("you are an idiot".split()) > g.clause("an idiot".split())
    assert g.clause("not an idiot".split()) < g.clause("an idiot".split())
    assert g.clause("they said an idiot".split()) < g.clause("an idiot".split())
    assert g.weight("loweiung") == 4.0
    assert g.clause("kill".split()) == 0 < g.clause("kill you".split())
    assert g.features(None) == g.features("") == (0.0, 0.0)


def test_line_frequency(spark):
    rows = [(i, f"Common line number {i}!\nown text {chr(97 + i % 26)}{'abcdefghij'[i // 26]} "
                + " ".join(f"u{chr(97 + j)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for j in range(12)),
             "h") for i in range(60)]
    rows += [(100 + i, "Common line number 3", "h") for i in range(5)]
    rows += [(200 + i, "Common line number 3 beside ten other words of a quiet host here", "q")
             for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rule = rules.LineRules(min_docs=20, min_words=2, min_left=3)
    got = {r.doc_id: r for r in rules.judge(df, rule).collect()}
    assert got[0].words_removed == 4 and got[0].kept
    assert got[100].depleted and not got[100].kept
    assert got[200].kept and got[200].words_removed == 0
    left = {r.doc_id: r.text for r in rules.cleaned(df, rule).collect()}
    assert 100 not in left and left[200] == rows[-3][1]
    assert left[0] == rows[0][1].split("\n")[1]


def test_odd_rows(spark, odd):
    empty = odd.limit(0)
    for df, n in ((odd, 8), (empty, 0)):
        assert exact.exact_dedup(df).count() == n
        assert rules.judge(df).count() == n
        assert near.near_components(df).count() == n
        assert mix.mixed(df.drop("id"), mix.Mix(), F.col("lang")).count() == n
        assert shards.shard(df, 4).count() == n
        assert license.scan(df).count() == n
        assert toxic.score(df, toxic.Grammar({"idiot": 5.0}, {})).count() == n
        assert repeats.remove_repeats(df).count() == n
        for stage in (rules.cleaned, exact.deduplicated, near.deduplicated):
            assert stage(df).columns == df.columns
        assert mix.taken(df, mix.Mix(), F.col("lang")).columns == df.columns
    kept = exact.exact_dedup(odd.drop("kept")).filter("kept").collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "4", "5", "6", "None"]
    scanned = {r.doc_id: r for r in license.scan(odd).collect()}
    assert scanned[6].base_labels == "mit" and scanned[1].n_words == 0
    assert near.near_components(odd).filter("doc_id = 4").first().component_id == 3


def test_chat_odd(spark):
    rows = [(1, 0, "a", "hi"), (1, 1, "b", "<|assistant|>"), (1, None, None, None),
            (None, 0, "a", "x"), (2, 0, "system", "s"), (3, 300, "a", "late"), (3, 1, "b", "soon")]
    got = chat.rotate(spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.speaker) for r in got} == {
        (1, "a"), (1, "b"), (1, "unknown"), (None, "a"), (3, "a"), (3, "b")}
    for r in got:
        spans = [r.rendered[m.start:m.end] for m in r.mask]
        assert all(s.endswith("<|end|>\n") for s in spans)
        assert r.rendered.count("<|assistant|>") == len(spans)
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")
                       ).count() == 0


def test_mix_redistributes(spark):
    rows = [(i, "w " * 10, "en", f"src{s}", d) for d, s, n in
            (("a", 0, 1), ("a", 1, 30), ("b", 2, 30)) for i in range(100 * s, 100 * s + n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, d string")
    got = mix.mixed(df, mix.Mix(percent=50, max_epochs=1), F.col("d")).collect()
    used = defaultdict(int)
    for r in got:
        used[r.source] += r.copies * r.n_tokens
    # src0 has 10 of its 76 tokens; the rest goes to its sibling, not to the other domain.
    assert used["src0"] == 10 and used["src1"] == 140 and used["src2"] == 150


def test_pipeline_brute_force(spark, docs, texts):
    d = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r.doc_id: r for r in d.collect()}
        d = stage(spark, d, SF)
        assert d.columns == docs.columns
        after = d.collect()
        if name == "quality rules":
            good = {r.doc_id for r in rules.judge(
                docs, corpus_pipeline.LINES).filter("kept").collect()}
            assert {r.doc_id for r in after} == good
        elif name == "exact dedup":
            keys = {re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in before.values()}
            assert len(after) == len(keys)
        elif name == "near dedup":
            groups = near_groups({i: r.text for i, r in before.items()},
                                 corpus_pipeline.NEAR.percent)
            assert {r.doc_id for r in after} == {i for i, (_, c) in groups.items() if i == c}
        else:
            con = duckdb.connect()
            frame = spark.createDataFrame(list(before.values()), docs.schema).toPandas()
            con.register("documents", frame)
            want = con.sql(queries.ORACLES["op9_target_mix"]).df()
            copies = {int(i): int(c) for i, c in zip(want.doc_id, want.copies) if c}
            assert Counter(r.doc_id for r in after) == copies
    rows = corpus_pipeline.packing(spark, d, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in d.collect()}
