"""Every stage of the pipeline, on its own input, against plain versions; and the edges of each."""

import re
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from lodestrata.llm import common, language_id, packing
from test_jaccard_join import brute as jaccard_components
from test_mixing import targets as mix_targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark):
    """Inputs and outputs of the five stages over the smallest documents and awkward rows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*cp.COLUMNS)
    long = " ".join(r["text"] for r in docs.where("lang = 'en'").limit(30).collect() if r["text"])
    same = docs.where("lang = 'fr'").first()
    more = [
        (5001, None, "en", "src1", None),
        (5002, "", "en", None, 0),
        (5003, "1234 !!", None, "src1", 7),
        (5004, long, "en", None, len(long)),
        (5005, same["text"], None, None, None),
        (None, same["text"], "fr", "src2", 3),
        (5006, same["text"] + " fin", "fr", "src2", 3),
        (5006, same["text"] + " fin", "fr", "src2", 3),
    ]
    docs = common.durable(docs.union(spark.createDataFrame(more, SCHEMA)))
    out = []
    for _, stage in cp.STAGES:
        made = common.durable(stage(spark, docs, "/root/testdata/sf0.001"))
        out.append((docs, made))
        docs = made
    return out


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def run_dedup(rows):
    """Texts without the pairs of neighbouring lines that a smaller id has, or the text itself before; null ids are last."""
    split = [(2**63 - 1 if d is None else d, (t or "").split("\n")) for d, t in rows]
    least, out = {}, []
    for d, lines in split:
        for pair in zip(lines, lines[1:], strict=False):
            least[pair] = min(d, least.get(pair, d))
    for (d, lines), (_, text) in zip(split, rows, strict=True):
        dead, first = set(), {}
        for i, pair in enumerate(zip(lines, lines[1:], strict=False)):
            if any(pair) and (first.setdefault(pair, i) + 2 <= i or least[pair] < d):
                dead |= {i, i + 1}
        out.append("\n".join(x for i, x in enumerate(lines) if i not in dead) if dead else text)
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "mixing", "packing"]
    for docs, made in stages[:4]:
        assert docs.columns == made.columns == cp.COLUMNS
    assert stages[4][1].columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_language(stages):
    docs, made = stages[0]
    found = {(r["doc_id"], r["text"]): r for r in language_id.identify(docs).collect()}
    want = Counter((r["doc_id"], r["text"], r["lang_pred"], r["source"], r["n_chars"]) for r in found.values() if not r["rejected"])
    assert set(rows_of(made)) == set(want)
    gone = {d for d, *_ in rows_of(docs)} - {d for d, *_ in rows_of(made)}
    assert {5001, 5002, 5003} <= gone and len(gone) <= 5


def test_lines(stages):
    docs, made = stages[1]
    rows = rows_of(docs)
    kept = run_dedup([(r[0], r[1]) for r in rows])
    want = Counter()
    for r, text in zip(rows, kept, strict=True):
        if text == r[1]:
            want[r] += 1
        elif re.search(r"[^ \t-\r]", text):
            want[(r[0], text, r[2], r[3], len(text))] += 1
    assert Counter(rows_of(made)) == want


def test_near_duplicates(stages):
    docs, made = stages[2]
    rows = rows_of(docs)
    ids = [r[0] for r in rows]
    component = jaccard_components([(i, r[1]) for i, r in enumerate(rows)])
    least = defaultdict(list)
    for i, (_, c) in component.items():
        least[c].append(i)
    want = set()
    for members in least.values():
        known = [ids[i] for i in members if ids[i] is not None]
        want |= {min(known)} if known else {None}
    assert {r[0] for r in rows_of(made)} == want
    assert max(Counter(r[0] for r in rows_of(made) if r[0] is not None).values()) == 1
    assert set(rows_of(made)) <= set(rows)


def test_mixture(stages):
    docs, made = stages[3]
    words = lambda t: len(re.findall(r"[^ \t-\r]+", t or ""))
    rows = rows_of(docs)
    size = Counter()
    for r in rows:
        size[r[3]] += words(r[1])
    target = mix_targets(size)
    taken, largest = Counter(), max(words(r[1]) for r in rows)
    copies = Counter(rows_of(made))
    for r, n in copies.items():
        assert n <= 2 and r in set(rows)
        taken[r[3]] += n * words(r[1])
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest


def test_packed(stages):
    docs, made = stages[4]
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for r in docs.collect():
        n = len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        for k, at in enumerate(range(0, n, 2048)):
            want[r["doc_id"], k, at, min(2048, n - at)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in made.collect()) == want
    sequences = defaultdict(list)
    for r in made.collect():
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.mark.parametrize(("name", "stage"), cp.STAGES)
def test_empty_and_extra(spark, name, stage):
    clash = "doc_id long, text string, lang string, source string, n_chars long, rejected string, n_removed string, cls string, copy int, piece string"
    assert stage(spark, spark.createDataFrame([], clash), "").count() == 0
    text = "the cat sat on the mat and the dog of the house ate all of it in the end"
    rows = [(1, text, "en", "a", 1, "x", "x", "x", 1, "x"), (2, None, None, None, None, *[None] * 5), (None, text + " too", "en", None, 2, "x", "x", "x", 1, "x")]
    out = stage(spark, spark.createDataFrame(rows, clash), "")
    assert 1 in [r["doc_id"] for r in out.collect()]
    assert out.columns == (cp.COLUMNS if name != "packing" else packing.pack_documents(spark.createDataFrame([], SCHEMA)).columns)


def test_run_is_the_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id % 4 = 0")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = cp.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect()
    here = docs
    for _, stage in cp.STAGES:
        here = common.durable(stage(spark, here, str(tmp_path)))
    assert Counter(map(tuple, got)) == Counter(map(tuple, here.drop("sequence_id", "offset").collect()))
