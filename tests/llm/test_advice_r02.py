"""Cases of the second review: each failed before its finding was settled."""

import random

import corpus_pipeline
from tests.llm.test_llm import near_groups
from tickloom.llm import license, toxic


def test_pipeline_links_from_80_percent(spark):
    """Pairs with a similarity from 0.80 to below 0.85 leave one document each."""
    rows = []
    for k in range(12):
        own = [f"w{k}x{i}" for i in range(104)]
        edit = own[:94] + [f"e{k}x{i}" for i in range(10)]  # 90 of 110 shingles in common
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(edit))]
    groups = near_groups(dict(rows), percent=80)
    assert near_groups(dict(rows), percent=85) != groups
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_copies(spark, df, "").collect()}
    assert got == {i for i, (_, c) in groups.items() if i == c} == set(range(0, 24, 2))


def test_pipeline_keeps_one_of_many_near_copies(spark):
    """Hundreds of near copies in one host leave one document, boilerplate still goes."""
    word = lambda *k: "v" + "".join(chr(97 + int(c)) for c in "q".join(map(str, k)) if c != "q")
    lines = [" ".join(word(1, i, j) for j in range(20)) for i in range(6)]
    rows = [(k, "\n".join([*lines, f"note {word(2, k)}"]), "h") for k in range(300)]
    footer = "this footer stands below every other page of the host"
    rows += [(1000 + k, " ".join(word(3, k, j) for j in range(30)) + "\n" + footer, "h")
             for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for _, run in corpus_pipeline.STAGES[:3]:
        docs = run(spark, docs, "")
    left = {r.doc_id: r.text for r in docs.collect()}
    assert set(left) == {0} | {1000 + k for k in range(150)}
    assert left[0] == rows[0][1]
    assert not any(footer in t for t in left.values())


def test_pipeline_judges_host_sizes_alike(spark):
    """A line in a fifth of a host's documents goes, in a host of 50 as in one of 600."""
    line = "the same notice stands here in a fifth of all pages"
    word = lambda *k: "".join(chr(97 + int(c)) for c in "".join(f"{x:03d}" for x in k))
    rows = [(1000 * n + k, " ".join(word(n, k, j) for j in range(20)) + f"\n{line}" * (k % 5 == 0), f"h{n}")
            for n in (50, 600) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = corpus_pipeline.quality(spark, df, "").collect()
    assert len(left) == 650 and not any(line in r.text for r in left)


def test_license_blocks_start_anywhere(spark):
    """A notice with inserted words is found at every offset; the scan equals all starts."""
    notice = "licensed x x under x cc x by x nc x 4 0"
    rows = [(k, " ".join(["y"] * k + [notice])) for k in range(15)]
    rng = random.Random(5)
    vocabulary = sorted({w for t in license.TEMPLATES.values() for w in t.split()})
    for k in range(300):
        words = rng.choice(list(license.TEMPLATES.values())).split()
        words = [w for w in words if rng.random() < 0.92]
        for _ in range(rng.randrange(2 * len(words))):
            words.insert(rng.randrange(len(words)), rng.choice(["x", "y", rng.choice(vocabulary)]))
        rows.append((100 + k, " ".join(["z"] * rng.randrange(40) + words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in license.scan(df).collect()}
    assert all("cc-by-nc" in got[k].labels.split(",") for k in range(15))
    found = 0
    for k, text in rows:
        words, want = license.words_in(text), {}
        for label, template in license.TEMPLATES.items():
            own = license.words_in(template)
            size = len(set(own))
            best = max(len(set(words[i:i + 2 * len(own)]) & set(own)) for i in range(len(words)))
            if 100 * best >= 80 * size:
                want[label] = best / size
        have = {}
        for b in got[k].blocks:
            have[b.label] = max(have.get(b.label, 0), b.containment)
        assert have == want
        found += len(want)
    assert found > 100


def test_threat_meets_a_target_on_either_side():
    """Verb-final and object-first threats emit, inflected ones as well; alone they do not."""
    g = toxic.Grammar({"idiot": 4.0}, {})
    for text in ("ich werde dich töten", "vous tuer", "they killed her", "killing them",
                 "sie wird euch umbringen"):
        assert g.features(text)[0] > 0, text
    assert g.features("killing time") == (0.0, 0.0)
    assert g.clause("du wurdest nie getötet".split()) < g.clause("du wurdest getötet".split())


def test_composed_transducers():
    """The composed table gives what a plain reading of the rules gives."""
    g = toxic.Grammar({"idiot": 4.0, "scum": 2.0}, {})
    rng = random.Random(3)
    for _ in range(500):
        words = rng.choices(["idiot", "scum", "a", "b", "you", "kill", "not", "said"], k=12)
        near = lambda i, w: w in words[max(0, i - 3):i]
        total, kept = 0.0, 0.0
        for i, w in enumerate(words):
            damp = (0.5 if near(i, "not") else 1) * (0.5 if "said" in words[:i] else 1)
            if w in g.words:
                total += g.words[w] * damp * (1.25 if near(i, "you") else 1)
                kept = 0.0 if near(i, "you") else 0.25 * g.words[w] * damp
            elif w == "you":
                total, kept = total + kept + 4 * damp * near(i, "kill"), 0.0
            elif w == "kill":
                total += 4 * damp * near(i, "you")
        assert abs(g.clause(words) - total) < 1e-9
