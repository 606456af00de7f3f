"""Pages of many blocks: slabs of steps give what the whole page gives, in bounded memory."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from nimbogrid.llm import html_extraction


def page(n: int) -> str:
    maker = html_extraction.PageMaker(3)
    return "<html><body>" + "".join(maker.page()[0].split("<body>")[1].split("</body>")[0] for _ in range(n)) + "</body></html>"


@pytest.mark.parametrize("slab", [1, 7, 64, 10_000])
def test_slabs_give_what_the_whole_page_gives(slab):
    net = html_extraction.BlockLSTM(6, seed=2)
    found = html_extraction.blocks(page(12))
    assert len(found) > 128
    x, mask = html_extraction.padded([html_extraction.vectors(found)])
    assert np.allclose(net.forward_long(found, slab), net.forward(x, mask)[:, 0], atol=1e-4)


def test_long_and_short_pages_together():
    net = html_extraction.BlockLSTM(6, seed=2)
    pages = [page(1), None, page(9), "", page(2)]
    assert html_extraction.extract(net, pages, most_steps=20) == html_extraction.extract(net, pages)


def test_equal_elements_are_held_once():
    found = html_extraction.blocks("<div class=a>" + "<p>x <a href=y>z</a>" * 1000)
    assert len(found) == 1000 and len(found.elements) == 2
    assert found[-1][0] == "x z" and found[3:5] == [found[3], found[4]] and 0 < found[0][2] < 1


def test_memory_of_a_page_of_tiny_blocks():
    """Two million blocks in ten megabytes: the parser and one direction's slab of vectors stay small."""
    code = """
import resource, numpy as np
from nimbogrid.llm import html_extraction as h
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
found = h.blocks("<p>ab" * 2_000_000)
assert len(found) == 2_000_000
x = h.vectors(found[1_000_000:1_040_000])
assert x.shape == (40_000, h.INPUT)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300, cwd=Path(__file__).resolve().parents[2])
    assert int(done.stdout) < 500
