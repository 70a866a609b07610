"""Pages nested without end: paths are shared, so that no block costs more than its own."""

import time

import numpy as np

from tessera.llm.html_extract import Block, Labeller, Path, blocks, vectors


def test_deep_nesting_is_linear():
    for page in ("<div>word " * 50_000, "<b>" * 50_000 + "<div>w " * 50_000, "<p>" + "<b>" * 20_000 + "<h1>x" * 20_000, "<table>" + "<i>x " * 50_000 + "</u>" * 50_000):
        begin = time.process_time()
        found = blocks(page)
        read = vectors(found, Labeller())
        assert time.process_time() - begin < 20
        assert len(read) == len(found) > 0 and np.isfinite(read).all()


def test_shared_paths_have_the_bag_of_all_their_names():
    names = ["html", "body x y", "div x", "p"]
    shared = Path.of(names)
    other = Path(shared.parent, "h1 z")
    page = [Block(shared, "a", 0), Block(other, "b", 0), Block(shared.parent, "c", 0), Block(None, "d", 0)]
    plain = [Block(names, "a", 0), Block([*names[:3], "h1 z"], "b", 0), Block(names[:3], "c", 0), Block((), "d", 0)]
    assert [b.path for b in page] == [b.path for b in plain]
    assert np.array_equal(vectors(page, Labeller()), vectors(plain, Labeller()))
    assert vectors(page, Labeller(path_size=32)).shape[1] == Labeller(path_size=32).inputs
    assert np.array_equal(vectors(page, Labeller()), vectors(plain, Labeller()))
