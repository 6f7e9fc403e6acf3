"""Each stage of the pipeline on what the one before it kept, against plain Python."""

import collections

import numpy as np
from test_search import brute_jaccard
from test_texts import packed_well

import corpus_pipeline
from tracewell.llm import jaccard, packing, pii, toxicity
from tracewell.llm.store import written

SF = "/root/testdata/sf0.001"


def stages(spark, docs):
    """The input and output of each stage."""
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF), f"test-{name}")
        yield name, docs, out
        docs = out


def key(r):
    return tuple("" if x is None else str(x) for x in r)


def redacted(text):
    out, last = "", 0
    for s, kind, e, _ in pii.find(text):
        if s >= last:
            out += text[last:s] + f"[{kind.upper()}]"
        last = max(last, e)
    return out + text[last:]


def test_stages_equal_plain_python(spark, documents, labels):
    seen = []
    for name, before, after in stages(spark, documents):
        seen.append(name)
        old, new = before.collect(), after.collect()
        if name == "toxicity":
            scores = {r["doc_id"]: r["score"] for r in toxicity.score(before, toxicity.fit(before, labels, held_out_fold=None)).collect()}
            assert {r["doc_id"] for r in new} == {d for d, s in scores.items() if s < 0.5}
            toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
            clean = {r["doc_id"] for r in labels.where("toxic = 0").collect()}
            kept = {r["doc_id"] for r in new}
            assert len(toxic & kept) <= 0.1 * len(toxic) and len(clean - kept) <= 0.02 * len(clean)
        elif name == "near_duplicates":
            groups = brute_jaccard([(r["doc_id"], r["text"]) for r in old])
            assert {r["doc_id"] for r in new} == {d for d, (_, g) in groups.items() if d == g}
        elif name == "personal_data":
            texts = {r["doc_id"]: r["text"] for r in old}
            assert all(r["text"] == redacted(texts[r["doc_id"]]) and r["n_chars"] == len(r["text"]) for r in new) and len(new) == len(old)
        elif name == "mixing":
            assert collections.Counter(map(key, old)) == collections.Counter(map(key, new))
        else:
            coder = packing.encoder(packing.default_tokenizer())
            packed_well(new, {r["doc_id"]: [*np.frombuffer(coder.encode(r["text"] or ""), "<u4").tolist(), 2] for r in old})
        if name != "packing":
            assert after.columns == documents.columns
    assert seen == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]


def test_awkward_rows_pass_all_stages(spark, nasty, empty):
    kept = {name: out for name, _, out in stages(spark, nasty)}
    assert kept["near_duplicates"].where("doc_id in (1, 2, 3, 4, 5, 7, 9, 10)").count() == 8 and kept["near_duplicates"].where("doc_id = 6").count() == 0
    assert kept["mixing"].count() == kept["near_duplicates"].count() and kept["mixing"].where("doc_id is null").count() == 2
    assert kept["packing"].where("piece = 0").count() == kept["mixing"].count()
    assert all(out.count() == 0 for _, _, out in stages(spark, empty))


def test_sequences_follow_the_mix(spark):
    words = "one two three four five six seven eight nine ten "
    docs = spark.createDataFrame([(k, words * (5 + k % 40), "hot" if k % 3 == 0 else f"s{k % 4}") for k in range(6000)], "doc_id bigint, text string, source string")
    mixed = written(corpus_pipeline.mix_sources(spark, docs, SF), "test-mixed")
    rows = corpus_pipeline.pack_sequences(spark, mixed, SF).collect()
    last = {}
    for r in rows:
        last[r["doc_id"]] = max(last.get(r["doc_id"], 0), r["sequence_id"])
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sizes = collections.Counter(source.values())
    weight = {s: n**0.5 / sum(x**0.5 for x in sizes.values()) for s, n in sizes.items()}
    order = [source[d] for d in sorted(last, key=last.get)]
    for t in range(1000, int(0.9 * min(n / weight[s] for s, n in sizes.items())), 500):
        seen = collections.Counter(order[:t])
        assert all(abs(seen[s] / t - w) < 0.05 for s, w in weight.items())


def test_an_id_with_several_texts_keeps_the_one_compared(spark):
    words = " ".join(f"w{k}" for k in range(30))
    other = " ".join(f"v{k}" for k in range(30))
    rows = [(1, words, "b"), (1, other, "a"), (2, words, "a"), (3, other, "a"), (4, "alone here", "b"), (4, "alone here", "a"), (None, words, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    first = {r["doc_id"]: r for r in jaccard.join(docs).collect()}
    for n in (1, 3, 7):
        got = sorted(corpus_pipeline.drop_near_duplicates(spark, docs.repartition(n), SF).collect(), key=key)
        by = {r["doc_id"]: r for r in got}
        linked = 2 if first[2]["group_id"] == 1 else 3  # which of them equals the text that stands for document 1
        assert set(by) == {1, 4, None, 5 - linked} and len(got) == 4
        assert by[1]["text"] == (words if linked == 2 else other) and by[4]["source"] == "a"
