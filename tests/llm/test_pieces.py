import random

import pytest

from sedimenta.llm import pieces as C


@pytest.mark.parametrize("segment", [1, 500, 1300])
def test_segments_give_the_pieces_of_the_whole_text(monkeypatch, segment):
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "größe ", "漢字。", "end. ", "\n", "\n\n", "\r\n\r\n", "x" * 40]) for _ in range(rng.randint(0, 600)))
        limit = rng.choice((40, 90, 200))
        whole = C.split(text, limit, 15)
        with monkeypatch.context() as m:
            m.setattr(C, "SEGMENT", segment)
            assert C.split(text, limit, 15) == whole


def test_a_text_of_many_megabytes(monkeypatch):
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = C.split("many plain words\n" * 2_000_000, 4000, 200)
    assert len(got) > 8000 and got[-1][1] == 34_000_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_200_000
