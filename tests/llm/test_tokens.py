import random

from pulsegrid.llm import tokens as T


def library_ids(text):
    lib = T.load_tokenizer(T.BYTE_BPE)
    return lib.encode(text, add_special_tokens=False).ids


def texts_of_all_kinds():
    rng = random.Random(4)
    latin = [chr(c) for c in range(256)]
    letters = "abcdefghijklmnopqrstuvwxyzéñßü"
    texts = ["", " ", "\n\n  \n", "a" * 3000, " \t" * 500, "don't we'll I'M x's 12 3.4,5", "\x85\xa0a\x1c b", "<|endoftext|>", "a<|endoftext|> b", "日本 é", "é"]
    texts += ["".join(rng.choice(latin) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice(letters + "  \n") for _ in range(rng.randint(1, 200))) for _ in range(3000)]
    return texts


def test_pieces_give_the_ids_of_whole_texts():
    encoder = T.byte_level(T.BYTE_BPE)
    assert encoder.by_piece
    texts = texts_of_all_kinds()
    got = [ids.tolist() for at in range(0, len(texts), 700) for ids in encoder.many(texts[at : at + 700])]
    want = [e.ids for e in encoder.lib.encode_batch(texts, add_special_tokens=False)]
    assert got == want


def test_starting_anew_changes_nothing(monkeypatch):
    texts = texts_of_all_kinds()[:600]
    want = [ids.tolist() for ids in T.ByteLevelIds(T.BYTE_BPE).many(texts)]
    monkeypatch.setattr(T, "KNOWN_PIECES", 50)
    encoder = T.ByteLevelIds(T.BYTE_BPE)
    assert [ids.tolist() for at in range(0, 600, 7) for ids in encoder.many(texts[at : at + 7])] == want


def test_ids_of_all_documents(spark):
    encoder = T.byte_level(T.BYTE_BPE)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    texts = [r.text or "" for r in rows]
    assert [ids.tolist() for ids in encoder.many(texts)] == [e.ids for e in encoder.lib.encode_batch(texts, add_special_tokens=False)]


def test_the_library_reads_each_word_once_in_few_texts():
    """Of any script: repeats and pieces one by one cost more than the ids themselves."""
    encoder, read = T.ByteLevelIds(T.BYTE_BPE), []
    lib = encoder.lib

    class Recorded:
        def encode_batch_fast(self, texts, **how):
            read.extend(texts)
            return lib.encode_batch_fast(texts, **how)

    encoder.lib = Recorded()
    words = [f"λόγος{n}," for n in range(1000)]
    texts = ["word " + " ".join(words[k:] + words[:k]) for k in range(10)] + ["two  spaces \n and　more 　 λόγος0, "]
    got = [ids.tolist() for ids in encoder.many(texts)]
    assert got == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert len(read) < 40 and sum(map(len, read)) < 3 * sum(map(len, words))


class Recorded:
    def __init__(self, lib):
        self.lib, self.read = lib, []

    def encode_batch_fast(self, texts, **how):
        self.read.extend(texts)
        return self.lib.encode_batch_fast(texts, **how)


def test_cuts_beside_white_space_and_marks_of_all_kinds():
    encoder, rng = T.ByteLevelIds(T.BYTE_BPE), random.Random(8)
    some = "  \n\t\r\x0b\x0c\x1c\x1f\x00\x7f\x85\xa0\u1680\u180e\u2003\u200b\u2028\u202f\u205f\u3000\u2019Āſжѿ\u0482\u0483\u2177\u0301\u65e5\u3042\u201c\u30fb'stm.,-_09aZ\xaa\xb5\xb2\xbd\xd7\xf7éß\U0001f600"
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 12))) for _ in range(20_000)]
    got = [ids.tolist() for at in range(0, len(texts), 900) for ids in encoder.many(texts[at : at + 900])]
    assert got == [e.ids for e in encoder.lib.encode_batch(texts, add_special_tokens=False)]


def test_words_that_differ_in_marks_and_line_breaks_are_read_once():
    encoder = T.ByteLevelIds(T.BYTE_BPE)
    encoder.lib = known = Recorded(encoder.lib)
    words = ["".join(chr(97 + n // 26**k % 26) for k in range(3)) + "élan" for n in range(1000)]
    texts = ["".join(f" {w}{end}" for w in words) for end in ("", ",", ".", ".\nThe", "###", '"', " (7)")]
    got = [ids.tolist() for ids in encoder.many(texts)]
    assert got == [e.ids for e in known.lib.encode_batch(texts, add_special_tokens=False)]
    assert sum(map(len, known.read)) < 2 * sum(map(len, words))


def test_pieces_that_come_back_are_kept_when_room_ends(monkeypatch):
    monkeypatch.setattr(T, "KNOWN_PIECES", 300)
    encoder = T.ByteLevelIds(T.BYTE_BPE)
    encoder.lib = known = Recorded(encoder.lib)
    common = " ".join(f"common{chr(97 + k)}" for k in range(26))
    texts = [common + "".join(f" rare{chr(97 + n % 26)}{chr(97 + n // 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(100)) for n in range(40)]
    got = [encoder.many([t])[0].tolist() for t in texts]
    assert got == [e.ids for e in known.lib.encode_batch(texts, add_special_tokens=False)]
    assert sum(t.count("commonb") for t in known.read) == 1 and len(encoder.place) <= 450


def test_groups_of_texts_and_whole_ones_keep_their_order(monkeypatch):
    monkeypatch.setattr(T, "CHARS", 40)
    encoder, texts = T.ByteLevelIds(T.BYTE_BPE), texts_of_all_kinds()[:400]
    texts += ["", "<|endoftext|>", "", "x " * 50, "<|endoftext|> y", " z"]
    assert [ids.tolist() for ids in encoder.many(texts)] == [e.ids for e in encoder.lib.encode_batch(texts, add_special_tokens=False)]
    assert encoder.many([]) == [] and [len(ids) for ids in encoder.many(["", ""])] == [0, 0]
