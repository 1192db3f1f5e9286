import json
import pickle
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import langid, pieces, tokencount
from plumbline.llm.queries import PIECES, VOCABULARY, vocabulary
from plumbline.session import file_bytes

rng = random.Random(1)
TEXTS = ["", " hi", "a\n\n b\t", "x" * 3000, "\x1c\x1d a\x85b\xa0 c d​e", "日本語テスト🎉" * 50, "  hi   \n\n x", "ab" * 500 + " " * 77, "'s'll don't I'M ²½Ⅷ", "</s> <s> <unk><0x0A>", "▁▁ a▁b", " " * 40, "a<|endoftext|>b", " <|endoftext|> <|endoftext|>", "été " * 30, "The quick brown fox"]
TEXTS += ["".join(chr(rng.choice([32, rng.randrange(1, 128), rng.randrange(128, 0x3000), rng.randrange(0x3000, 0xD800)])) for _ in range(60)) for _ in range(150)]
TEXTS += ["".join(rng.choice("abcdeinrst ▁\n  the") for _ in range(80)) for _ in range(150)]


def frame(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(900, None), (None, "x"), (1, " hi")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit(1))


def test_counts_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = vocabulary(VOCABULARY)
    known = tokenizers.Tokenizer.from_file(path)
    want = [len(e.ids) for e in known.encode_batch(TEXTS, add_special_tokens=False)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in tokencount.token_counts(frame(spark), path).collect()}
    assert [got[k][1] for k in range(len(TEXTS))] == want
    assert [got[k][0] for k in range(len(TEXTS))] == [len(t.encode()) for t in TEXTS]
    assert got[900] == (0, 0) and got[None] == (1, 1)
    assert tokencount.token_counts(frame(spark).limit(0), path).count() == 0


def test_whole_tokens_are_proven():
    merger = tokencount.Merger(file_bytes(vocabulary(VOCABULARY)))
    whole = merger.prove()
    assert len(whole) > 0.9 * len(merger.vocabulary) * 0.98 and " the" in whole
    long = merger.spell("abcdefgh" * 40)
    parts = list(long)
    while True:
        best = min(((merger.ranks.get(p, 1 << 60), k) for k, p in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 60, 0))
        if best[0] == 1 << 60:
            break
        parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]
    assert merger.count(long) == len(parts)


@pytest.mark.parametrize(
    "change",
    [
        lambda s: s.update(normalizer={"type": "NFC"}), lambda s: s["pre_tokenizer"].update(add_prefix_space=True), lambda s: s["model"].update(byte_fallback=True),
        lambda s: s["added_tokens"].append(s["added_tokens"][0] | {"content": "<x>", "special": False}), lambda s: s["added_tokens"][0].update(lstrip=True),
    ],
)
def test_other_vocabularies_are_refused(change):
    spec = json.loads(file_bytes(vocabulary(VOCABULARY)))
    change(spec)
    with pytest.raises(ValueError, match="not supported"):
        tokencount.Merger(json.dumps(spec).encode())


def test_ids_equal_the_library_and_decode(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = vocabulary(PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = pieces.encode_documents(frame(spark), path).cache()
    got = {r["doc_id"]: r for r in out.collect()}
    assert [got[k]["ids"] for k in range(len(TEXTS))] == model.encode(TEXTS)
    assert all(r["round_trip"] for r in got.values()) and got[900]["ids"] == []
    back = {r["doc_id"]: r["text"] for r in pieces.decode_documents(out, path).collect()}
    assert [back[k] for k in range(len(TEXTS))] == [t.replace("▁", " ") for t in TEXTS]
    assert pieces.encode_documents(frame(spark).limit(0), path).count() == 0


def test_languages(spark):
    words = {"en": "the and of to in that is was for with", "fr": "le la les des une dans pour que qui été", "de": "der die das und nicht ist ein für mit über"}
    rows = [(k, " ".join(rng.choices(words[lang].split(), k=rng.choice([5, 30]))), lang) for k, lang in enumerate(list(words) * 60)]
    docs = spark.createDataFrame(rows + [(500, None, "en"), (501, "12 .", "en"), (502, "the", None), (503, "", "fr")], "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("x"))
    model = langid.fit(docs.where(~langid.held_out()))
    got = {r["doc_id"]: r for r in langid.predict(docs, model).withColumn("held", langid.held_out()).collect()}
    held = [(i, lang) for i, _, lang in rows if got[i]["held"]]
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in held]) > 0.97
    assert [got[i]["lang_pred"] for i in (500, 501, 502, 503)] == ["und", "und", "en", "und"]
    assert all(0 <= r["lang_score"] <= 1 for r in got.values())
    nothing = langid.fit(docs.where("lang = 'xx'"))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_popcounts_against_sets():
    grams, owner = langid.grams_of(np.frombuffer("abcdefé ab".encode(), np.uint8), np.array([0, 8, 11]))
    assert len(grams) == len(owner) and set(owner.tolist()) == {0, 1}
    model = langid.Model(("x", "y"), np.zeros((1, 1 << 12), np.uint64), 2)
    for at in langid.slot_numbers(grams[:5], 2, 1 << 12):
        model.slots[0, at] |= np.uint64(1)
    masks = model.masks(grams)
    assert (masks[0][:5] == 1).all()
    counts, total = langid.tally(model, np.frombuffer(b"abcdefg", np.uint8), np.array([0, 7]))
    assert counts[0, 1] == 0 and counts[0, 0] <= total[0]


def test_piece_models_of_other_settings_are_refused():
    pb2 = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    spec = pb2.ModelProto()
    with open(vocabulary(PIECES), "rb") as file:
        spec.ParseFromString(file.read())
    for change in ({"model_type": 1}, {"byte_fallback": False}, {"precompiled_charsmap": b"x"}, {"remove_extra_whitespaces": True}):
        other = pb2.ModelProto()
        other.CopyFrom(spec)
        for name, value in change.items():
            setattr(other.normalizer_spec if hasattr(other.normalizer_spec, name) else other.trainer_spec, name, value)
        with pytest.raises(ValueError):
            pieces.Transducer(other.SerializeToString())


def test_shortest_path_is_the_only_finite_one():
    """Against all paths of short strings: exactly one has finite weight, and ``path`` returns it."""
    with open(vocabulary(PIECES), "rb") as file:
        machine = pieces.Transducer(file.read())

    def every(text, place, last):
        if place == len(text):
            yield []
            return
        for end, piece in machine.arcs(text, place):
            if last is None or machine.weight(last, piece) == 0:
                for rest in every(text, end, piece):
                    yield [piece, *rest]

    for text in ["▁the", "▁thening", "ationth", "▁un▁", "éàé", "▁▁▁x", "xyzzy", "▁inter", "erheration"]:
        paths = list(every(text, 0, None))
        assert len(paths) == 1
        want = [k for p in paths[0] for k in ([machine.ids[p]] if p in machine.ids else [machine.bytes[b] for b in p.encode()])]
        assert machine.path(text) == want
    memo = pieces.Memo(machine)
    data, bounds = np.frombuffer("a bba b\n\n".encode(), np.uint8), np.array([0, 0, 3, 5, 9])
    ids, edges, same = pieces.encode_block(memo, data, bounds)
    assert same.all() and [machine.decode(ids[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)] == ["", "a b", "ba", " b\n\n"]


def test_surfaces_are_compared_for_all_segments_at_once_and_tasks_unpack_their_own_transducer():
    machine = pickle.loads(pieces.packed(vocabulary(PIECES)))
    assert machine is not pieces.compiled(pieces.file_bytes(vocabulary(PIECES))) and machine.clear is not None
    found = [machine.path(x) for x in ("▁the", "é", "▁un")]
    ids, sizes = np.array(sum(found, []), np.int32), np.array([len(x) for x in found])
    data = np.frombuffer(" theé xx the".encode(), np.uint8)
    starts, ends = np.array([0, 4, 6]), np.array([4, 6, 9])
    assert machine.gives_back(ids, sizes, data, starts, ends).tolist() == [True, True, False]
    assert machine.gives_back(ids, sizes, data, np.array([0, 4, 9]), np.array([4, 6, 13])).tolist() == [True, True, False]
    assert machine.gives_back(ids[:0], sizes[:0], data, starts[:0], ends[:0]).tolist() == []


def test_compiled_arcs_are_numbers_and_take_little_memory():
    machine = pickle.loads(pieces.packed(vocabulary(PIECES)))
    words = ["▁" + "".join(rng.choice("abcdeinrstlouphm") for _ in range(9)) for _ in range(4000)]
    tracemalloc.start()
    for word in words:
        machine.path(word)
    taken = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(machine.clear) > 5000 and taken < 160 * len(machine.clear)
    assert machine.path("é漢\U0010ffff")[-4:] == [machine.bytes[b] for b in "\U0010ffff".encode()]
