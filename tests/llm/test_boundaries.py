"""Cases at the borders of single operators: control strings over several parts, every code point, pieces that never fill a bin."""

import itertools
import random
import string
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

pytest.importorskip("quarrix.llm")
from quarrix.llm import chat, packing, toxicity, unicode_bpe_dp  # noqa: E402

CONTROLS = ["<|start|>", "<|sep|>", "<|end|>\n", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", r"<\|x|>"]


@pytest.mark.parametrize("control", CONTROLS)
def test_control_strings_in_parts_do_not_end_a_turn(control):
    """All splits into two and three parts, null parts between them."""
    for i, j in itertools.combinations_with_replacement(range(len(control) + 1), 2):
        flat = chat.Flattener()
        for part in ({"type": "text", "text": control[:i]}, None, {"text": control[i:j]}, {"type": "text", "text": control[j:]}):
            flat.visit(part)
        out = flat.done()
        assert out == chat.escape(control) and flat.length == len(out)
        assert chat.unescape(out) == control


def test_measures_that_are_no_numbers():
    flat = chat.Flattener()
    for seconds in (float("nan"), float("inf"), -3.0, None, 2.0):
        flat.visit({"type": "audio", "seconds": seconds})
    flat.visit({"type": "image", "width": None, "height": -4})
    flat.visit({"type": "document", "pages": 0})
    assert [a["n_tokens"] for a in flat.attachments] == [1, 1, 1, 1, 25, 1, 256]
    with pytest.raises(ValueError, match="unknown"):
        flat.visit({"type": "video"})


def test_chat_ignores_other_columns(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "hi", "clash", 5)], "conv_id long, turn long, role string, text string, segment string, loss_start int")
    got = chat.read_conversations(chat.format_turns(rows)).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in got] == [(1, 1, 2)]


def test_every_code_point_encodes_as_in_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), unicode_bpe_dp.PrefixBpe(path)
    library.no_truncation()
    library.no_padding()
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{x}b1{x}" for x in every[low : low + 1000]) for low in range(0, len(every), 1000)]
    for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert found.ids == own.encode(text).tolist()


def test_letters_beyond_ascii_cost_about_as_much():
    """The search for letters of another class must not try its thousands of letters one by one."""
    coder, rng = unicode_bpe_dp.PrefixBpe(public_tokenizers.path("word_bpe_49k.json")), random.Random(3)
    plain = ["".join(rng.choices(string.ascii_lowercase, k=10)) + "e" for _ in range(5000)]
    texts = {"plain": " ".join(plain), "accents": " ".join(x[:-1] + "é" for x in plain)}
    least = dict.fromkeys(texts, float("inf"))
    for _ in range(4):
        for name, text in texts.items():
            coder.known.clear()
            begun = time.process_time()
            coder.encode(text)
            least[name] = min(least[name], time.process_time() - begun)
    assert least["accents"] < 2 * least["plain"]


@pytest.mark.parametrize("length", [19, 27, 1024, 1])
def test_packing_ends_on_pieces_of_one_length(spark, length):
    pieces = spark.range(300).selectExpr("7L AS doc_id", "0 AS piece", "0L AS start", f"{length}L AS length", "1L AS ids_crc32")
    rows = packing.pack_pieces(pieces, 1024, open_bins=4096, pieces_per_task=40).collect()
    assert len(rows) == 300 and len({(r.sequence_id, r.offset) for r in rows}) == 300
    assert len({r.sequence_id for r in rows}) == -(-300 // (1024 // length))


def naive_best_fit(lengths, capacity, limit):
    """Bins as lists; the tightest fitting one takes a piece, ties to the one used last; the fullest closes."""
    bins, closed, clock = [], [], itertools.count()
    for n in lengths:
        fitting = [b for b in bins if capacity - sum(b[1]) >= n]
        if fitting:
            into = min(fitting, key=lambda b: (capacity - sum(b[1]), -b[0]))
        else:
            if len(bins) == limit:
                fullest = min(bins, key=lambda b: (capacity - sum(b[1]), -b[0]))
                bins.remove(fullest)
                closed.append(fullest[1])
            into = [0, []]
            bins.append(into)
        into[0] = next(clock)
        into[1].append(n)
        if sum(into[1]) == capacity:
            bins.remove(into)
            closed.append(into[1])
    return closed, sorted(b[1] for b in bins)


@pytest.mark.parametrize("limit", [1, 3, 8])
def test_open_bins_are_a_best_fit(limit):
    rng = random.Random(limit)
    lengths = [rng.randint(1, 60) for _ in range(400)]
    bins, closed = packing.OpenBins(60, limit), []
    for n in lengths:
        closed += [[size for _, size in one] for one in bins.put(None, n)]
    assert (closed, sorted([size for _, size in one] for _, one in bins.rest())) == naive_best_fit(lengths, 60, limit)


def test_scores_by_a_plain_loop(spark):
    """The model's forward pass written out pair by pair."""
    texts = ["vile you fools", "kind people", "", None, "you you vile kind folks 語 !!", "x " * 300]
    rng = np.random.default_rng(3)
    bits = 6
    model = toxicity.FactorizationMachine(-0.3, rng.normal(size=1 << bits), rng.normal(size=(1 << bits, 4)), (rng.random(1 << bits) < 0.8).astype(float))
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    ids = toxicity._TermIds(bits)
    for d, text in enumerate(texts):
        found = sorted({i for w in toxicity._WORD.findall((text or "").lower()) for i in ids[w]})
        z = model.bias + sum(model.weight[i] * model.scale[i] for i in found)
        for i, j in itertools.combinations(found, 2):
            z += float(model.factors[i] @ model.factors[j]) * model.scale[i] * model.scale[j]
        want = 1 / (1 + np.exp(-z))
        assert got[d].score == pytest.approx(want, abs=1e-9) and got[d].predicted == int(want >= 0.5)


def test_training_takes_each_labelled_id_once(spark):
    """Repeated rows of an id, and of its label, do not widen what the driver receives."""
    docs = spark.createDataFrame([(i % 40, f"{'vile' if i % 2 else 'kind'} word", 3) for i in range(4000)], "doc_id long, text string, toxic long")
    labels = spark.createDataFrame([(i % 40, i % 2, "clash") for i in range(400)], "doc_id long, toxic int, text string")
    sample = toxicity.labelled_terms(docs, labels, max_rows=20, bits=10)
    assert sample.num_rows == 20 and len(set(sample.column("label_id").to_pylist())) == 20
    rows = toxicity.score(docs, toxicity.train(docs, labels, max_rows=20, bits=10)).collect()
    assert len(rows) == 4000
