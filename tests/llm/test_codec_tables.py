import random

from wayloom.llm import sentencepiece_codec


def test_pairs_of_pieces_are_judged_once_for_all_tasks(monkeypatch):
    with open(sentencepiece_codec.MODEL, "rb") as f:
        codec = sentencepiece_codec.Codec(sentencepiece_codec.Model(f.read()))
    r = random.Random(9)
    texts = ["".join(r.choice("aeiou thnrs.,") for _ in range(200)) for _ in range(50)]
    first = [codec.encode(t) for t in texts]
    codec.forget()
    assert not codec.cut and not codec.old_cut and not codec.part
    monkeypatch.setattr(codec, "joins", lambda *a: 1 / 0)
    assert [codec.encode(t) for t in texts] == first
