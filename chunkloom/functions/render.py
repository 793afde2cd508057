"""Views of single documents for a notebook: HTML and text from spans. They take what one row holds and never touch a cluster."""

from __future__ import annotations

from html import escape

Span = tuple[int, int]
COLOURS = ("#fde2e4", "#e2ece9", "#fff1e6", "#dfe7fd", "#f0efeb", "#e2f0cb")


def _shown(text: str) -> str:
    return escape(text).replace("\n", "<br>")


def chunks_html(text: str, spans: list[Span]) -> str:
    """The chunks in turning colours; where chunks overlap the part stands in both, underlined."""
    out, reach = [], 0
    for i, (a, b) in enumerate(spans):
        again = f"<u>{_shown(text[a : min(b, reach)])}</u>" if a < reach else ""
        out.append(f'<span style="background:{COLOURS[i % len(COLOURS)]}" title="chunk {i}">{again}{_shown(text[max(a, min(b, reach)) : b])}</span>')
        reach = max(reach, b)
    return "".join(out)


def chunks_markdown(text: str, spans: list[Span]) -> str:
    """The chunks with rules between them."""
    return "\n\n<hr>\n\n".join(text[a:b] for a, b in spans)


def clusters_html(text: str, clusters: list[list[Span]]) -> str:
    """Mentions (inclusive ends) in the colour of their cluster, with its number; the outer one of nested mentions is shown."""
    found = sorted(((a, b, k) for k, c in enumerate(clusters) for a, b in c), key=lambda m: (m[0], -m[1]))
    out, at = [], 0
    for a, b, k in found:
        if a >= at:
            out.append(f'{_shown(text[at:a])}<span style="background:{COLOURS[k % len(COLOURS)]}">{_shown(text[a : b + 1])}<sub>{k}</sub></span>')
            at = b + 1
    return "".join(out) + _shown(text[at:])


def pairs_html(text: str, pairs: list[tuple[Span, Span]]) -> str:
    """Pronouns, each followed by its entity."""
    out, at = [], 0
    for (ea, eb), (a, b) in sorted(pairs, key=lambda p: p[1]):
        if a >= at:
            out.append(f"{_shown(text[at:a])}<b>{_shown(text[a : b + 1])}</b><sup>{_shown(text[ea : eb + 1])}</sup>")
            at = b + 1
    return "".join(out) + _shown(text[at:])


def document_html(row) -> str:
    """A parsed document: its pages under each other, block boundaries as bars."""
    out, at = [], 0
    marks = sorted(row["split_points"] or ())
    for page in row["pages"] or ():
        end = at + len(page["text"])
        edges = [at, *(m for m in marks if at < m < end), end]
        body = '<span style="color:#c00">|</span>'.join(_shown(row["full_text"][a:b]) for a, b in zip(edges, edges[1:]))
        out.append(f"<h4>page {page['page']}</h4><div>{body}</div>")
        at = end
    return "".join(out)
