from __future__ import annotations

from chunkloom.functions import render


def test_views_keep_the_text():
    text = "Ann <b> saw\nBob. She left."
    html = render.chunks_html(text, [(0, 12), (8, len(text))])
    assert "Ann &lt;b&gt; saw<br>" in html and "<u>saw<br></u>" in html and html.count("<span") == 2
    assert render.chunks_markdown("ab", [(0, 1), (1, 2)]) == "a\n\n<hr>\n\nb"
    assert render.clusters_html(text, [[(0, 2), (17, 19)], [(12, 14)]]).count("<sub>") == 3
    assert "<b>She</b><sup>Ann</sup>" in render.pairs_html(text, [((0, 2), (17, 19))])
    assert render.document_html({"pages": [{"page": 1, "text": "abc"}, {"page": 2, "text": "d"}], "full_text": "abcd", "split_points": [1, 3]}).count("|") == 1
