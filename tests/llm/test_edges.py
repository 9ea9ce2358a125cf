"""Cases that single operators once answered wrongly."""

import numpy as np
import pyarrow as pa

from trafficlens.llm import html_text, pii
from trafficlens.llm.common import Rolling, slices


def test_parts_of_an_address_may_be_long():
    zeros, nines = "see 1.2.3." + "0" * 5000, "see 1.2.3." + "9" * 5000
    assert pii.base_spans(zeros) == [(4, len(zeros), "ip")] and pii.base_spans(nines) == []


def test_names_of_what_stands_beside_a_surrounding():
    body = "<h1>T</h1><p>Body of the article</p>"
    for attribute in ('class="content with-sidebar"', 'id="no-comments"', 'class="hasSidebar story"'):
        assert html_text.Page(f"<body><div {attribute}>{body}</div><div class=sidebar>Other</div></body>").text(None) == "T Body of the article"
    for name in ("sidebar", "post-comments", "site_nav", "cookie-notice"):
        assert html_text.Page(f"<body><div>{body}</div><div class={name}>Other</div></body>").text(None) == "T Body of the article"


def test_a_long_text_after_an_empty_one_is_a_slice_of_its_own():
    texts = pa.array(["", "x" * 100, "", "y", "z" * 9])
    assert list(slices(texts, 10)) == [(0, 1), (1, 2), (2, 5)]


def test_powers_of_long_arrays_are_not_kept(monkeypatch):
    monkeypatch.setattr(Rolling, "KEEP", 1 << 17)
    kept = len(Rolling._power)
    values = np.arange(max(kept, 1 << 17) + 5, dtype=np.uint64)
    long = Rolling(values)
    assert len(Rolling._power) == kept
    a, b = np.array([len(values) - 9]), np.array([len(values) - 2])
    assert long.of(a, b) == Rolling(values[-9:]).of(np.array([0]), np.array([7]))
