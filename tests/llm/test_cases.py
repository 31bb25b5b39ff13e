"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator and stage."""

import hashlib
import inspect
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymere.llm import bpe, chat, common, exact_dedup, line_dedup, mixing, ngram_join, quality_classifier, quality_rules, queries, url_filters, warc
from tallymere.llm.common import new_path
from tallymere.llm.components import components
from tallymere.llm.words import Words

from .test_queries import brute_groups, library

LONG = " ".join(f"w{k % 977}x{k}" for k in range(20_000))
ROWS = [
    (1, "one two three four five six", "a"), (2, "one two three four five six", "a"), (2, "one two three four five six", "a"), (3, None, None), (4, "", "b"), (5, " \n\t", "b"),
    (6, LONG, "a"), (7, LONG + " end", None), (None, "no id at all here", "a"), (8, "é ü\nß", "c"), (8, "another text under this id", "c"),
]
SCHEMA = "doc_id long, text string, source string"


def used_names() -> list[str]:
    """Every plain string of the operators' code that could name a column, so that each is tried as an extra column."""
    found = set()
    for module in (bpe, chat, exact_dedup, line_dedup, mixing, ngram_join, quality_classifier, quality_rules, common):
        found |= set(re.findall(r"""["'`]([a-z_][a-z_0-9]{0,30})["'`]""", inspect.getsource(module)))
        found |= set(re.findall(r"(_[a-z_]+|[a-z_]+) (?:bigint|int|long|string|binary|double|boolean)", inspect.getsource(module)))
    return sorted(found - {"doc_id", "text", "source"})


CLASHES = [*used_names(), "a column.with a dot"]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def labels(spark, rows=((1, 1), (6, 1), (5, 0), (None, 0), (4, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int")


OPERATORS = {
    "exact": lambda s, d: exact_dedup.exact_duplicates(d),
    "lines": lambda s, d: line_dedup.dedup_lines(d),
    "mix": lambda s, d: mixing.mix_sources(d),
    "groups": lambda s, d: ngram_join.ngram_groups(d, n=4, percent=85),
    "bpe": lambda s, d: bpe.encode_texts(d, queries.tokenizer_path()),
    "rules": lambda s, d: quality_rules.judge_quality(d, labels(s)),
    "classifier": lambda s, d: quality_classifier.classify(d, labels(s)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_per_document(spark, name):
    assert OPERATORS[name](spark, clashing(table(spark))).count() == len(ROWS)
    assert OPERATORS[name](spark, table(spark, [])).count() == 0
    assert OPERATORS[name](spark, table(spark, [(None, None, None)])).count() == 1


STAGES = {
    "exact": lambda s, d: exact_dedup.drop_exact_duplicates(d),
    "near": lambda s, d: ngram_join.drop_near_duplicates(d),
    "rules": lambda s, d: quality_rules.keep_quality(d, labels(s)),
    "mix": lambda s, d: mixing.mixed_rows(d),
}


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stages_keep_columns(spark, name):
    df = clashing(table(spark))
    assert STAGES[name](spark, df).schema == df.schema or STAGES[name](spark, df).dtypes == df.dtypes
    assert all(r["kept"] == "own kept" and r["_row"] == "own _row" for r in STAGES[name](spark, df).collect())
    assert STAGES[name](spark, table(spark, [])).count() == 0


def test_exact_duplicates(spark):
    rows = [tuple(r) for r in exact_dedup.exact_duplicates(table(spark), keep="max").select("doc_id", "keep_id", "group_size", "kept").collect()]
    assert sorted(rows, key=str) == sorted([(1, 2, 3, False), (2, 2, 3, True), (2, 2, 3, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 1, True), (None, None, 1, True), (8, 8, 1, True), (8, 8, 1, True)], key=str)
    kept = exact_dedup.drop_exact_duplicates(table(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(["1", "3", "5", "6", "7", "None", "8", "8"])
    assert next(r for r in kept if r["doc_id"] == 3)["text"] is None


def test_line_dedup_removes_shared_passages(spark):
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(8))
    passage = [line() for _ in range(40)]
    docs = [(k, "\n".join([line() for _ in range(rng.randint(1, 9))] + passage + [line() for _ in range(3)]), "a") for k in range(12)]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(table(spark, docs)).collect()}
    assert out[0]["removed_lines"] == 0 and out[0]["text"] == docs[0][1]
    for k, text, _ in docs[1:]:
        own = [x for x in text.split("\n") if x not in passage]
        left = out[k]["text"].split("\n")
        assert all(x in left for x in own) and sum(x in passage for x in left) <= 12
    assert len(out) == 12


def test_single_lines_and_unique_texts_stay(spark):
    docs = [(1, "same line", "a"), (2, "same line", "a"), (3, "other\n\n", "a"), (4, "other\n\n", "a")]
    assert [r["removed_lines"] for r in line_dedup.dedup_lines(table(spark, docs)).collect()] == [0] * 4


def _without_repeats(docs, least=50):
    """Brute force: lines of every run of more than `least` words that stands at an earlier place, not overlapping itself there."""
    first, left = {}, {}
    for key, text in docs:
        lines = [(k, x, len(re.findall(r"[^ \t-\r]+", x))) for k, x in enumerate(text.split("\n"))]
        worded, gone = [x for x in lines if x[2]], set()
        for i in range(len(worded)):
            for j in range(i, len(worded)):
                run = tuple(x[1] for x in worded[i : j + 1])
                if sum(x[2] for x in worded[i : j + 1]) > least:
                    d, at = first.setdefault(run, (key, i))
                    if d != key or i >= at + len(run):
                        gone.update(x[0] for x in worded[i : j + 1])
        left[key] = "\n".join(x for k, x, _ in lines if k not in gone)
    return left


def test_passages_of_any_number_of_lines_go(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**9)}"
    docs, own, passages = [], {}, {}
    for n in range(1, 11):
        size = [60 // n] * n
        size[-1] += 60 - sum(size)
        passages[n] = [" ".join(word() for _ in range(k)) for k in size]
    for key in range(40):
        around = [" ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(6)]
        own[key] = "\n".join(around)
        at = rng.randint(0, 6)
        docs.append((key, "\n".join([*around[:at], *passages[key % 10 + 1], *around[at:]]), "a"))
    out = {r["doc_id"]: r for r in line_dedup.dedup_passages(table(spark, docs)).collect()}
    for key, text, _ in docs:
        assert out[key]["text"] == (text if key < 10 else own[key])
        assert (out[key]["removed_lines"], out[key]["removed_words"]) == ((0, 0) if key < 10 else (key % 10 + 1, 60))


def test_passages_as_brute_force(spark):
    rng = random.Random(12)
    pool = [" ".join(f"{c}{k}" for k in range(n)) for c, n in zip("abcdefgh", (1, 3, 9, 20, 25, 50, 51, 70), strict=True)] + ["", " \t"]
    docs = [(key, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14))), "a") for key in range(60)]
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_passages(table(spark, docs)).collect()}
    assert out == _without_repeats([d[:2] for d in docs])
    short = [(k, "same line\n" + "x " * 47 + "y", "a") for k in range(3)]  # 50 words
    assert [r["removed_lines"] for r in line_dedup.dedup_passages(table(spark, short)).collect()] == [0] * 3
    assert line_dedup.dedup_passages(table(spark)).count() == len(ROWS)


def test_mixing_meets_targets(spark):
    rng = random.Random(5)
    docs = [(k, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for k in range(3000)]
    rows = mixing.mix_sources(table(spark, docs)).collect()
    sizes, taken, target = {}, {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
    weight = dict(zip([*sorted(s for s in sizes if s), None], [5, 2, 1, 5, 2], strict=False))
    want, free, rest = {}, set(sizes), sum(sizes.values())
    while True:  # reshare by weight until none is above its cap
        level = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if level[s] > 3 * sizes[s]}
        if not over:
            want |= level
            break
        for s in over:
            want[s] = 3 * sizes[s]
            rest -= want[s]
        free -= over
    assert all(abs(want[s] - target[s]) < 1e-6 * want[s] and abs(taken[s] - want[s]) <= 60 for s in sizes)
    copies = {r["doc_id"]: r["copies"] for r in rows}
    assert {r[0]: r[1] for r in mixing.mixed_rows(table(spark, docs)).groupBy("doc_id").count().collect()} == {k: v for k, v in copies.items() if v}


def variants(rng, n, words, share):
    base = [f"b{rng.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, share)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("percent,n", [(85, 4), (80, 5), (60, 2)])
def test_groups_near_the_threshold(spark, percent, n):
    """Many sets around the threshold, so that links are missed by pivots and tiles must find them."""
    rng, docs = random.Random(percent), []
    for words in (3, 5, 8, 13, 40, 41, 120, 300):
        for share in (1, 3, 8):
            docs += variants(rng, 14, words, share)
    docs += ["", " ", "x", "x", "x y", "X Y", "x y z"]
    rng.shuffle(docs)
    rows = list(enumerate(docs))
    got = {r[0]: (r[1], r[2]) for r in ngram_join.ngram_groups(table(spark, [(i, t, "a") for i, t in rows]), n=n, percent=percent).collect()}
    assert got == brute_groups(rows, n, percent)


def test_linked_sets_share_a_leading_shingle():
    """Sets that differ as much as links allow share a leading shingle, whatever the sketch says, and pass the bitmaps."""
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 5, 1 << ngram_join.SKETCH_BITS).astype(np.uint32)
    for percent in (80, 85):
        for size in [*range(1, 60), 100, 333, 1000, 4000]:
            x = np.unique(rng.integers(0, 2**64, size, np.uint64))
            for _ in range(6):
                out = int(rng.integers(0, max(1, len(x) * (100 - percent) // 100 + 1)))
                y = np.unique(np.concatenate((rng.permutation(x)[out:], rng.integers(0, 2**64, int(rng.integers(0, 2 + len(x) // 8)), np.uint64))))
                if ngram_join._linked(x, y, percent):
                    assert set(ngram_join.leading(x, counts, percent)) & set(ngram_join.leading(y, counts, percent))
                    assert ngram_join._may_link(len(x), len(y), ngram_join.differing(ngram_join.bitmap(x), ngram_join.bitmap(y)), percent)


def test_bitmaps_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for size in (1, 30, 31, 33, 64, 500, 3000):
        x = np.unique(rng.integers(0, 2**64, size, np.uint64))
        y = np.unique(np.concatenate((x[: size // 2], rng.integers(0, 2**64, size * 2, np.uint64))))
        assert ngram_join.differing(ngram_join.bitmap(x), ngram_join.bitmap(y)) <= len(np.setxor1d(x, y))


def thue_morse(k: int) -> tuple[str, str]:
    """Two words of 2 ** k letters that any polynomial hash modulo 2 ** 64 takes for one."""
    a, b = "a", "b"
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


def test_words_that_fool_polynomial_hashes(spark):
    a, b = thue_morse(11)
    assert len(set(Words(pa.array([f"{a} {b} {a}"])).hashes().tolist())) == 2
    got = {r[0]: r[2] for r in ngram_join.ngram_groups(table(spark, [(1, f"{a} {a}x", "s"), (2, f"{b} {b}x", "s")]), n=4, percent=85).collect()}
    assert got == {1: 1, 2: 2}
    s = quality_rules.text_statistics(pa.array([f"{a}\n{b}\n{a}", f"{a} {a} {a} {b} {b} {b}"]))
    assert s["n_dup_lines"].tolist() == [1, 0] and s["n_repeat_words"].tolist() == [0, 0]


def test_one_id_with_several_texts(spark):
    """An id that repeats with other texts has the links of all of them, copies of other ids included."""
    w = [" ".join(f"{c}{k}" for k in range(40)) for c in "abcd"]
    rows = [(8, w[0], "s"), (8, w[1], "s"), (3, w[0], "s"), (5, w[1], "s"), (9, w[2], "s"), (9, w[0] + " x", "s"), (7, w[2] + " y", "s"), (6, w[3], "s"), (6, w[3], "s")]
    got = {r[0]: r[2] for r in ngram_join.ngram_groups(table(spark, rows)).collect()}
    assert got == {8: 3, 3: 3, 5: 3, 9: 3, 7: 3, 6: 6}


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 200) if k % 25] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)] + [(500, 501), (501, 500), (7, 7)]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == top(x) for x in root)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdeEÉ'sS  \n12.,!%<|>ΣİßÇ　漢é"), st.characters(codec="utf-8")), max_size=80))
def test_bpe_like_the_library(text):
    t, e = library(), _encoder()
    ids, said = e.encode([text, f"{text}<|endoftext|>{text}"])
    for want, got, decoded in zip((text, f"{text}<|endoftext|>{text}"), ids, said, strict=True):
        expected = t.encode(want, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == expected and decoded == t.decode(expected, skip_special_tokens=False)


_made = []


def _encoder():
    if not _made:
        _made.append(bpe.TextEncoder(open(queries.tokenizer_path(), encoding="utf-8").read()))
    return _made[0]


def test_bpe_of_very_long_words():
    t = library()
    for word in ("ab" * 3000, "x" * 70, "é" * 100, "the" * 40, "ab" * 3000 + "c " + "ab" * 3000 + "d " + "ab" * 1500, "a" * 200_000):
        ids, said = _encoder().encode([word])
        expected = t.encode(word, add_special_tokens=False).ids
        assert np.frombuffer(ids[0], "<u4").tolist() == expected and said[0] == t.decode(expected, skip_special_tokens=False)


def test_tokenizer_files_of_another_kind_are_refused():
    import json

    d = json.loads(open(queries.tokenizer_path(), encoding="utf-8").read())
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"decoder": {"type": "BPEDecoder", "suffix": "</w>"}}, {"model": d["model"] | {"byte_fallback": True}}):
        with pytest.raises(ValueError, match="another kind"):
            bpe.TextEncoder(json.dumps(d | change))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab\\\n<|>im_start user", max_size=8), st.text(alphabet=st.sampled_from("a\\\n<>|[]/isINTmends_tarx"), max_size=40)), max_size=5), st.sampled_from(chat.CONTROL))
def test_chat_format_reads_back(turns, control):
    turns = [*turns, ("assistant", f"x{control}{control}\\{control}")]
    formatted, spans = chat.format_turns(turns)
    assert chat.read_turns(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert formatted.count(chat.TURN_START) == len(turns) and not any(c in formatted for c in chat.CONTROL if c not in (chat.TURN_START, chat.TURN_END))


def test_reply_trees(spark):
    rows = [
        (9, "t", 1, None, "user", "q", 0.0), (9, "t", 2, 1, "assistant", "a", 1.0), (9, "t", 3, 1, "assistant", "b", 2.0), (9, "t", 4, 2, "user", "c", 5.0), (9, "t", 5, 3, "user", "d", 1.0),
        (9, "t", 6, 7, "user", "loop", 0.0), (9, "t", 7, 6, "user", "loop", 0.0), (9, "t", 8, 99, "user", "orphan", 0.5), (10, "u", 1, None, "user", None, None),
    ]
    messages = spark.createDataFrame(rows, "id long, tree string, node long, parent long, role string, text string, score double")
    paths = {}
    for r in sorted(chat.chosen_paths(messages.select("tree", "node", "parent", "score"), best=3).collect(), key=lambda r: r["at"]):
        paths.setdefault((r["tree"], r["rank"]), []).append(r["node"])
    assert paths == {("t", 1): [1, 2, 4], ("t", 2): [1, 3, 5], ("t", 3): [8], ("u", 1): [1]}
    best = {r["id"]: chat.read_turns(r["formatted"]) for r in chat.format_trees(messages).collect()}
    assert best == {9: [("user", "q"), ("assistant", "a"), ("user", "c")], 10: [("user", "")]}


def test_reply_trees_like_brute_force(spark):
    """Random trees with orphans, loops and deep chains: the best paths by score, then length, then the smaller leaf."""
    rng, rows, want = random.Random(4), [], {}
    for tree in range(12):
        n = rng.randint(1, 60)
        parent = {k: None if k == 1 or rng.random() < 0.05 else k - 1 if tree % 3 == 0 else rng.randint(1, k - 1) for k in range(1, n + 1)}
        parent |= {901: 902, 902: 901, 903: 901} if tree % 2 else {950: 999}
        score = {k: rng.randint(0, 3) for k in parent}
        rows += [(f"t{tree}", k, p, float(score[k])) for k, p in parent.items()]
        paths = []
        for leaf in set(parent) - set(parent.values()):
            path, at = [], leaf
            while at in parent and at not in path:
                path.append(at)
                at = parent[at]
            if at not in path:
                paths.append((-sum(score[k] for k in path), -len(path), leaf, path[::-1]))
        want |= {(f"t{tree}", k + 1): p[3] for k, p in enumerate(sorted(paths)[:2])}
    got = {}
    for r in sorted(chat.chosen_paths(spark.createDataFrame(rows, "tree string, node long, parent long, score double"), best=2).collect(), key=lambda r: r["at"]):
        got.setdefault((r["tree"], r["rank"]), []).append(r["node"])
    assert got == want


def test_conversation_of_a_very_long_text(spark):
    text = "<|im_end|>\\[INST]é\n" * 60_000
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.format_conversations(df)).first()
    assert back["loss_text"] == text and back["turns"] == f"user\n{text}\nassistant\n{text}\n"


def test_conversations_with_nulls_ties_and_many_turns(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", "same"), (1, 1, "assistant", "same"), (None, 0, "user", "n"), *[(2, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(150)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"id": F.lit(1), "tree": F.lit("x"), "node": F.lit(5), "rank": F.lit(0)})
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert back[1]["turns"] == "user\n\n\nx\nassistant\nsame\nassistant\nsame\n" and back[1]["loss_text"] == "samesame" and back[None]["n_turns"] == 1
    assert back[2]["n_turns"] == 150 and back[2]["loss_text"] == "".join(f"t{k}" for k in range(1, 150, 2))
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_archive_round_trip(spark):
    big = "payload \r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.1\r\n é " * 5
    rows = [(3, "http://a", big), (1, None, big), (2, "http://b\r\nX: y%0A%2", "short"), (4, "u", "short"), (5, "", None), (None, "u", big), (6, "u", "x" * 300_000), (1, "again", big), (7, "u", "\r\n"), (8, "u", "WARC/1.1\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("own") for c in ("digest", "header", "payload", "id", "owner", "http", "record")})
    path, files = new_path(spark, "test-archive"), new_path(spark, "test-warc")
    warc.write_archive(*warc.warc_records(df, "page_id", "url", "html"), path)
    warc.export_warc(warc.read_archive(spark, path).repartition(2), files, rows_per_file=3)
    read = warc.parsed(warc.import_warc(spark, files))
    revisits = {(3, "http://a"), (None, "u")}
    want = sorted([(i, u, "response", None, t or "") for i, u, t in rows if (i, u) not in revisits or t != big] + [(i, u, "revisit", 1, "") for i, u in revisits], key=str)
    assert sorted([tuple(r) for r in read.select("id", "url", "record_type", "refers_to", "payload").collect()], key=str) == want
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    got = sorted([tuple(r) for r in warc.resolved(read).select("id", "url", "payload_digest", "payload_bytes").collect()], key=str)
    assert got == sorted([(i, u, sha(t), len((t or "").encode())) for i, u, t in rows], key=str)
    headers = [r["header"] for r in read.collect()]
    ids = {re.search(r"WARC-Record-ID: (\S+)", h)[1] for h in headers}
    assert len(ids) == len(rows) and all("\r\nWARC-Date: 20" in h for h in headers)
    assert spark.read.parquet(f"{path}/payloads").count() == len({t or "" for _, _, t in rows})


def test_archives_that_are_empty_damaged_or_cut(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    path, files = new_path(spark, "test-archive"), new_path(spark, "test-warc")
    warc.write_archive(*warc.warc_records(none, "page_id", "url", "html"), path)
    warc.export_warc(warc.read_archive(spark, path), files)
    assert warc.resolved(warc.parsed(warc.import_warc(spark, files))).count() == 0
    df = spark.createDataFrame([(1, "u", "some text"), (2, "u", "y" * 200), (3, "u", "y" * 200)], "page_id long, url string, html string")
    warc.write_archive(*warc.warc_records(df, "page_id", "url", "html"), f"{path}-b")
    records = warc.read_archive(spark, f"{path}-b")
    with pytest.raises(Exception, match="damaged"):
        warc.parsed(records.withColumn("record", F.replace(F.col("record"), F.lit("some text"), F.lit("same text")))).collect()
    with pytest.raises(Exception, match="length differs"):
        warc.parsed(records.withColumn("record", F.replace(F.col("record"), F.lit("some text"), F.lit("text")))).collect()
    with pytest.raises(Exception, match="isn't there"):
        warc.resolved(warc.parsed(records).where("id <> 2")).collect()
    warc.export_warc(records.select(F.substring("record", 1, 400).alias("record")), f"{files}-cut")
    with pytest.raises(Exception, match="ends inside|without Content-Length|length differs"):
        warc.parsed(warc.import_warc(spark, f"{files}-cut")).collect()


def brute_verdict(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, default))


def test_url_cases(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://COM/en/x?y#z"), (4, "https://a.b.Example.com/en/7?q"), (5, "http://example.com.evil.net/de/8"), (6, "x://example.net/de/8#"), (7, "http://notcom/en/"), (8, "http://a.com/en"), (9, "http://org/es/://x"), (10, "://com/en/"), (11, "http://example.comx/en/7"), (12, "http://.com/en/1"), (13, "http:///en/"), (14, "http://com/en/" + "x" * 300_000), (14, "http://com/en/1"), (14, "http://com/en/1")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("own") for c in ("host", "key", "stack", "_row", "_key", "_best", "rule", "a.b", "task", "at")})
    got = [(r["page_id"], (r["host"], r["path"], r["rule"], r["verdict"])) for r in url_filters.judge_urls(df).collect()]
    assert sorted(got, key=str) == sorted(((i, brute_verdict(u, url_filters.RULES)) for i, u in rows), key=str)
    assert url_filters.judge_urls(df).first()["key"] == "own" and url_filters.judge_urls(df.limit(0)).count() == 0
    assert all(r["verdict"] == "block" for r in url_filters.judge_urls(df, rules=(), default="block").collect())


#: The list of op10's contract, word by word; not taken from the code, whose list it checks.
CONTRACT = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def test_url_rules_are_those_of_the_contract(spark, tmp_path):
    """Each rule's own word, on urls that it alone or it as the longest decides, through the query."""
    urls = {
        "http://com/en/": "block", "http://a.com/en/7": "block", "http://example.com/en/6": "block", "http://example.com/en/7": "allow", "http://w.example.com/en/70": "allow",
        "http://net/de/": "allow", "http://a.net/de/8": "allow", "http://example.net/de/7": "allow", "http://example.net/de/8": "block", "http://w.example.net/de/80": "block",
        "http://org/es/": "block", "http://a.b.org/es/1": "block", "http://org/es": "allow", "http://a.de/es/": "allow",
    }
    rows = list(enumerate(urls))
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: tuple(r)[1:] for r in queries.op10_url_filters(spark, str(tmp_path)).collect()}
    assert got == {i: brute_verdict(u, CONTRACT) for i, u in rows}
    assert {u: got[i][3] for i, u in rows} == urls


def test_many_nested_rules_like_brute_force(spark):
    """Rules as a table, nested several hosts deep, among hosts that lie between their intervals."""
    rng = random.Random(8)
    host = lambda: ".".join(rng.choice(["a", "b", "c-", "d/"[:1], "é", "a0", "-"]) for _ in range(rng.randint(1, 5)))
    rules = {(host(), rng.choice(["", "/", "/x", "/x/y", "/z"])): rng.choice(["allow", "block"]) for _ in range(150)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    rows = [(k, f"http://{host()}{rng.choice(['', '/', '/x', '/x/y/z', '/zz?q'])}") for k in range(600)]
    table_ = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge_urls(spark.createDataFrame(rows, "page_id long, url string").repartition(3), rules=table_).collect()}
    assert got == {i: brute_verdict(u, rules) for i, u in rows}


def test_forest_without_labels_and_rules_of_one_kind(spark):
    docs = [(k, " ".join(f"word{k}x{j}" for j in range(60)), "a") for k in range(40)] + [(99, "$$ ## " * 40 + " ".join(f"v{j}" for j in range(80)), "a")]
    for known in ([], [(1, 1), (2, 1)], [(99, 0)]):
        rows = quality_rules.judge_quality(table(spark, docs), labels(spark, known)).collect()
        assert all(r["kept"] for r in rows if r["doc_id"] < 40)
    rows = quality_rules.judge_quality(table(spark, docs), labels(spark, [(99, 0), *[(k, 1) for k in range(20)]])).collect()
    assert {r["doc_id"] for r in rows if not r["kept"]} == {99}


def test_rare_kinds_outside_the_sample_score_high(spark):
    clean = [(k, 100, 500, 0, 0, 0, 10, 10 + k % 3) for k in range(600)]
    odd = {1000: (100, 500, 0, 0, 0, 10, 500), 1001: (100, 500, 0, 0, 45, 10, 10), 1002: (100, 1500, 0, 0, 0, 10, 10), 1003: (100, 500, 0, 5, 0, 10, 10)}
    stats = spark.createDataFrame([*clean, *((k, *v) for k, v in odd.items())], "_id long, " + ", ".join(f"{n} long" for n in quality_rules.STATISTICS))
    # rows of a hash in the sample would make the test blind
    taken = {r["_id"] for r in quality_rules.hash_sample(stats, "_id", 16, *quality_rules.STATISTICS).collect()}
    assert not taken & set(odd)
    forest = quality_rules.fit(stats, labels(spark, ((0, 1), (1, 1), (1000, 0), (1002, 0))), trees=2 * 4, rows=2)
    score = {r["_id"]: r["score"] for r in quality_rules._scored(stats, forest).collect()}
    assert min(score[k] for k in odd) > max(score[k[0]] for k in clean)


def test_statistics_of_odd_texts():
    s = quality_rules.text_statistics(pa.array([None, "", "\n\n", "a\na\n a", "漢字 漢字"]))
    assert s["n_words"].tolist() == [0, 0, 0, 3, 2] and s["n_dup_lines"].tolist() == [0, 0, 0, 1, 0] and s["word_chars"].tolist() == [0, 0, 0, 3, 4]
