"""Texts are scored in groups of bounded size, whole where they are no longer than a part."""
from scrollwork.llm import language_id as L


def test_groups_are_smaller_than_parts_and_keep_texts_whole():
    texts = ["x" * (L.GROUP // 2)] * 8 + ["y" * (2 * L.GROUP)]
    groups = list(L.parts(texts))
    assert [t for g, _ in groups for t in g] == texts
    assert all(sum(map(len, g)) <= 3 * L.GROUP for g, _ in groups) and len(groups) > 3
