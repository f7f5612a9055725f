from cyclecast.llm import common


def test_what_is_kept_makes_room_for_another():
    made = []
    first, second = (common.kept(lambda x, n=n: made.append((n, x)) or x) for n in (1, 2))
    assert [first(5), first(5)] == [5, 5] and made == [(1, 5)]
    assert second(6) == 6 and first.cache_info().currsize == 0 and second.cache_info().currsize == 1
    assert first(5) == 5 and second.cache_info().currsize == 0 and made == [(1, 5), (2, 6), (1, 5)]


def test_models_and_tokenizers_share_a_place():
    from cyclecast.llm import langid, packing

    assert langid._scorer.cache_info and packing._encoder.cache_info and len(common._KEPT) >= 2
