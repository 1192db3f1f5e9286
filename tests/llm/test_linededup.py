import random
import re

import numpy as np

from plumbline.llm import graph, linededup
from plumbline.llm.linededup import dedup_lines, removals, segments, within
from plumbline.llm.queries import QUERIES
from tests.llm import brute


def normal(line):
    return " ".join(re.sub("[0-9]", "0", w) for w in brute.words(line))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def fixture():
    rng = random.Random(5)
    vocabulary = [f"v{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(300)]
    pool = [" ".join(rng.choices(vocabulary, k=rng.choice([2, 5, 9, 30, 60]))) for _ in range(40)]
    docs = []
    for k in range(50):
        lines = []
        for _ in range(rng.choice([1, 3, 8])):
            words = rng.choice(pool).split(" ")
            kind = rng.randrange(5)
            if kind == 1:
                words[rng.randrange(len(words))] += "q"
            elif kind == 2:
                words = [w.upper() + "!" for w in words] + ["2024"]
            elif kind == 3:
                words = rng.choices(vocabulary, k=12)
            elif kind == 4:
                words += ["1999"]
            lines.append(" ".join(words))
        docs.append((k, "\n".join(lines)))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "a b\n" * 50), (104, docs[0][1]), (105, pool[4] * 300), (106, pool[4] * 300 + "é"), (107, "\n" + pool[3] + "\n\n" + pool[3])]
    return docs


def by_edits(docs, min_words=1):
    """Every pair of distinct lines is compared, by edit similarity alone."""
    lines, first = {}, {}
    for doc_id, text in docs:
        for k, line in enumerate(text.split("\n") if text is not None else []):
            n = normal(line)
            if len(n.split()) >= min_words:
                lines[doc_id, k] = n
                first.setdefault(n, (doc_id, k))

    def linked(a, b):
        allowed = int(max(len(a), len(b)) * 0.1 + 1e-9)
        return abs(len(a) - len(b)) <= allowed and distance(a, b) <= allowed

    group = brute.components(sorted(first, key=first.get), linked)
    best = {}
    for n, g in group.items():
        best[g] = min(best.get(g, first[n]), first[n])
    out = {doc_id: [] for doc_id, _ in docs}
    for (doc_id, k), n in sorted(lines.items()):
        if best[group[n]] != (doc_id, k):
            out[doc_id].append(k)
    return out


def test_matches_all_pairs(spark):
    docs = fixture()
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("'z' as line", "doc_id", "text", "doc_id as low")
    want = by_edits(docs)
    assert {r["doc_id"]: r["removed_lines"] for r in removals(frame).collect()} == want
    cut = {r["doc_id"]: r for r in dedup_lines(frame).collect()}
    for doc_id, text in docs:
        left = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in want[doc_id])
        assert cut[doc_id]["text"] == left and cut[doc_id]["line"] == "z"
    assert sum(map(len, want.values())) > 60


def test_empty_and_repeated(spark):
    frame = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e\nq"), (2, "A, b. c d e\nx")], "doc_id long, text string")
    assert removals(frame.limit(0)).count() == 0
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in removals(frame).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 1)]


def edited():
    """Lines and copies of them, most further than three bits of SimHash apart; of all lengths and scripts."""
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choices(letters, k=rng.choice([2, 4, 6, 8])))
    lines = []
    for n in (5, 6, 8, 10, 14, 20, 40, 80, 150):
        for places in (1, 2, 3):
            words = [word() for _ in range(n)]
            lines.append(" ".join(words))
            allowed = len(lines[-1]) // 10
            for k in rng.sample(range(n), places):
                if len(words[k]) <= allowed:
                    words[k], allowed = "".join(rng.choices(letters, k=len(words[k]))), allowed - len(words[k])
            lines.append(" ".join(words))
    for n in (50, 55, 59):  # every edit in a place of its own
        line = "".join(rng.choices(letters + " ", k=n))
        normal_line = list(normal(line))
        lines.append("".join(normal_line))
        for k in range(5, len(normal_line) - 3, 10):
            normal_line[k] = "é"
        lines.append("".join(normal_line))
    return [(k, line) for k, line in enumerate(rng.sample(lines, len(lines)))]


def test_edit_similarity_alone_decides(spark):
    """Lines under 60 characters: every link, wherever the edits are. Longer ones: no wrong link, and nearly all."""
    docs = edited()
    want = by_edits(docs)
    got = {r["doc_id"]: r["removed_lines"] for r in removals(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    short = {k for k, line in docs if len(normal(line)) < 54}
    assert {k: v for k, v in got.items() if k in short} == {k: v for k, v in want.items() if k in short}
    assert all(not v or want[k] for k, v in got.items())
    assert sum(map(len, got.values())) >= 0.9 * sum(map(len, want.values())) > 25


def test_recall_of_longer_lines(spark):
    """Pairs of one to four edited words in lines of 60 to 1,200 characters."""
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    docs, pairs = [], 0
    for k in range(240):
        words = ["".join(rng.choices(letters, k=rng.choice([2, 3, 5, 7, 9]))) for _ in range(rng.choice([14, 20, 35, 60, 120, 200]))]
        line = " ".join(words)
        for _ in range(rng.choice([1, 1, 2, 2, 3, 4])):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], [words[at], "".join(rng.choices(letters, k=4))], ["".join(rng.choices(letters, k=5))]])
        pairs += int(within([line], [" ".join(words)])[0])
        docs += [(2 * k, line), (2 * k + 1, " ".join(words))]
    got = {r["doc_id"]: r["n_removed"] for r in removals(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert pairs > 150 and pairs >= sum(got.values()) >= 0.93 * pairs


def test_within_is_the_edit_distance():
    rng = random.Random(1)
    pairs = []
    for k in range(3000):
        a = "".join(rng.choices("ab é", k=rng.randrange(0, 25) if k % 3 else rng.randrange(60, 200)))
        b = list(a) if rng.random() < 0.8 else rng.choices("ab é", k=len(a))
        for _ in range(rng.randrange(1 + len(a) // 8)):
            b[(at := rng.randrange(len(b) + 1)) : at + rng.randrange(2)] = rng.choice(["", "a", "é", "日"])
        pairs.append((a, "".join(b)))
    got = within([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [distance(a, b) <= max(len(a), len(b)) // 10 for a, b in pairs]
    assert 500 < got.sum() < 2500
    long = ["ab cd" * 500 + "x" * 40 + "y" * 900, "ab cd" * 500 + "y" * 900]
    assert within(long[:1], long[1:]).all() and not within(long[:1], ["z" * 3400]).any()


def test_a_segment_of_every_short_pair_meets():
    rng = random.Random(2)
    for _ in range(4000):
        a = "".join(rng.choices("abc", k=rng.randrange(9, 60)))
        b = list(a)
        for _ in range(rng.randrange(1, 7)):
            b[(at := rng.randrange(len(b) + 1)) : at + rng.randrange(2)] = rng.choice(["", "a", "b"])
        a, b = sorted((a, "".join(b)), key=len)
        if a != b and 9 <= len(a) and len(b) < 60 and distance(a, b) <= len(b) // 10:
            keys = [{(salt, text[x : x + w]): role for x, w, salt, role in zip(*map(list, segments(len(text))), strict=True)} for text in (a, b)]
            assert any(role & 1 and keys[0].get(key, 0) & 2 for key, role in keys[1].items())


def test_query_finds_a_changed_word(spark, tmp_path):
    docs = [(1, "one two three four five six seven eight nine ten"), (2, "one two three four five sax seven eight nine ten")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["n_removed"] for r in QUERIES["op10_line_dedup"](spark, str(tmp_path)).collect()} == {1: 0, 2: 1}


def test_short_lines_and_lines_without_spaces(spark, tmp_path):
    chinese = "这是一行没有空格的文字它应当只留下一次"
    docs = [(1, "les\nall rights reserved\n\n" + chinese), (2, "Les!\nAll rights reserved.\n\n" + chinese), (3, "lesa\nall rights preserved\n" + chinese.replace("行", "段"))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["removed_lines"] for r in QUERIES["op10_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: [], 2: [0, 1, 3], 3: [1, 2]}


def test_a_common_passage_costs_no_square(spark, monkeypatch):
    """Lines that only share a passage are not alike: their pairs are no rows, and no link between the others is lost."""
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choices("etaoinshr", k=5)) for _ in range(n))
    passage = text(58)
    lines = [f"{text(11)} {passage} {text(11)}" for _ in range(120)]
    lines += [line.replace(passage[:40], passage[:40].replace("e", "u")) for line in lines[:30]]
    docs = list(enumerate(rng.sample(lines, len(lines))))
    pairs, verify = [], linededup.verified
    monkeypatch.setattr(linededup, "verified", lambda found: pairs.append(found.count()) or verify(found))
    monkeypatch.setattr(graph, "CROWD", 20)
    monkeypatch.setattr(graph, "BLOCK", 40)
    got = {r["doc_id"]: r["n_removed"] for r in removals(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    normals = [(k, normal(line)) for k, line in docs]
    group = brute.components([k for k, _ in docs], lambda a, b: bool(within([normals[a][1]], [normals[b][1]])[0]))
    assert got == {k: int(group[k] != k) for k, _ in docs} and sum(got.values()) >= 30
    assert sum(pairs) < 6 * len(docs)


def test_keys_are_dealt_in_packs_and_only_met_ones_become_rows(spark):
    rng = random.Random(9)
    given = [(rng.randrange(60), rng.randrange(30), rng.choice([9, 21]) * 4 + rng.choice([2, 3])) for _ in range(400)]
    found, met = linededup.met_keys(np.array(given, linededup.KEY_ROW))
    want = {}
    for key, id_, form in given:
        ids = want.setdefault(key, {})
        ids[id_] = ids.get(id_, 0) | form
    want = {k: v for k, v in want.items() if len(v) > 1 and any(f & linededup.INDEXED for f in v.values())}
    assert [tuple(x) for x in found.tolist()] == [(k, i, want[k][i]) for k in sorted(want) for i in sorted(want[k])]
    assert met.tolist() == [len(want[k]) for k, _, _ in found.tolist()]
    assert len(linededup.met_keys(np.zeros(0, linededup.KEY_ROW))[0]) == 0
    docs = spark.createDataFrame([(k, " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(8))) for k in range(1000)], "doc_id long, text string").coalesce(1)
    packs = linededup.key_packs(docs, 1).collect()
    keys = sum(len(p["rows"]) for p in packs) // linededup.KEY_ROW.itemsize
    assert keys > 20_000 and len(packs) <= 1 << linededup.PACKS_LOG2
    assert all(np.frombuffer(p["rows"], linededup.KEY_ROW)["key"].max() >> np.uint64(64 - linededup.PACKS_LOG2) == p["pack"] for p in packs)


def test_the_screen_of_couples_loses_no_pair():
    rng = random.Random(11)
    a = ["".join(rng.choices("abcdé fg", k=rng.randrange(10, 200))) for _ in range(500)]
    b = []
    for x in a:
        y = list(x)
        for _ in range(rng.randrange(len(x) // 10 + 1)):
            at = rng.randrange(len(y))
            y[at : at + rng.randrange(2)] = rng.choice(["", "q", "z"])
        b.append("".join(y))
    alike = np.array([distance(x, y) <= max(len(x), len(y)) // 10 for x, y in zip(a, b, strict=True)])
    assert alike.sum() > 400 and linededup.like(a, b)[alike].all() and (within(a, b) == alike).all()
    other = ["".join(rng.choices("hijklm no", k=len(x))) for x in a]
    assert not linededup.like(a, other).any()
