"""Raw parser results to parsed documents.

A parser has two phases: ``scan`` turns files into raw JSON by a service or library, and ``convert`` makes the canonical document from
raw JSON alone. The services are functions from bytes to JSON that the caller gives; spreadsheets and HTML are read here.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterable
from html.parser import HTMLParser
from typing import Protocol
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import add_columns
from ..functions.text import Counter, count_words
from . import readers

PAGE_BREAK = "<!-- PageBreak -->\n\n"
CANONICAL = "pages array<struct<page:int,text:string>>, full_text string, split_points array<int>, titles array<struct<title:string,start:int,end:int,level:int>>, error string"
#: Texts under so many tokens that follow each other are one block.
SHORT_BLOCK = 100


class Parser(Protocol):
    pattern: str

    def scan(self, content: bytes) -> str: ...
    def convert(self, raw: str) -> dict: ...


class Canonical:
    """Collects a document's text by page, with block boundaries and titles; offsets are those of the text as it ends up."""

    def __init__(self) -> None:
        self.pages: dict[int, list[str]] = {}
        self.marks: list[tuple[int, int]] = []
        self.titles: list[tuple[int, int, str, int]] = []

    def _at(self, page: int) -> int:
        return sum(map(len, self.pages.get(page, ())))

    def add(self, page: int, text: str, split: bool, level: int = 0) -> None:
        if level:
            self.titles.append((page, self._at(page), text.strip(), level))
        self.pages.setdefault(page, []).append(text)
        if split:
            self.marks.append((page, self._at(page)))

    def done(self, n_pages: int = 0) -> dict:
        numbers = sorted({*range(1, max([n_pages, *self.pages]) + 1), *self.pages}) if self.pages or n_pages else []
        texts = {n: "".join(self.pages.get(n, ())) for n in numbers}
        start, at = {}, 0
        for n in numbers:
            start[n] = at
            at += len(texts[n])
        found = sorted((start[p] + x, level, title) for p, x, title, level in self.titles)
        ends = [next((b for b, other, _ in found[i + 1 :] if other <= level), at) for i, (_, level, _) in enumerate(found)]
        return {
            "pages": [{"page": n, "text": texts[n]} for n in numbers], "full_text": "".join(texts.values()), "split_points": sorted({start[p] + x for p, x in self.marks} - {0, at}),
            "titles": [{"title": t, "start": a, "end": e, "level": level} for (a, level, t), e in zip(found, ends)],
        }


def markdown_table(rows: list[list[str]]) -> str:
    """The first row is the header."""
    clean = [["" if c is None else str(c).replace("|", "\\|").replace("\n", " ") for c in r] for r in rows]
    width = max(map(len, clean), default=0)
    lines = ["| " + " | ".join([*r, *[""] * (width - len(r))]) + " |" for r in clean]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]) if lines else ""


def split_rows(header: list[str], rows: list[list[str]], most: int, count: Counter = count_words) -> list[str]:
    """Tables of as many rows as fit, each with the header; a row above the limit is a table of its own."""
    if count(markdown_table([header, *rows])) <= most or not rows:
        return [markdown_table([header, *rows])]
    out, held = [], []
    for row in rows:
        if held and count(markdown_table([header, *held, row])) > most:
            out.append(markdown_table([header, *held]))
            held = []
        held.append(row)
    return [*out, markdown_table([header, *held])]


def split_table_text(table: str, most: int, count: Counter = count_words) -> list[str]:
    """A markdown table by lines, with header and rule repeated. Short or small ones stay as they are."""
    lines = table.strip("\n").split("\n")
    if len(lines) <= 3 or count(table) <= most:
        return [table]
    head, out, held = lines[:2], [], []
    for line in lines[2:]:
        if held and count("\n".join([*head, *held, line])) > most:
            out.append("\n".join([*head, *held]))
            held = []
        held.append(line)
    return [*out, "\n".join([*head, *held])]


class LayoutParser:
    """Document layout services: paragraphs with roles, tables, figures, and a tree of sections that refer to them by path."""

    pattern = "*.pdf"
    RANK = {"pageHeader": 0, "pageFooter": 2, "pageNumber": 3}

    def __init__(self, analyze: Callable[[bytes], str] | None = None, most: int = 1000, count: Counter = count_words) -> None:
        self.analyze, self.most, self.count = analyze, most, count

    def scan(self, content: bytes) -> str:
        if self.analyze is None:
            raise RuntimeError("a layout service is needed: LayoutParser(analyze=...)")
        return self.analyze(content)

    def _blocks(self, raw: dict) -> list[dict]:
        sections, seen, out = raw.get("sections") or [], set(), []

        def emit(name: str, i: int, depth: int) -> None:
            items = raw.get(name) or []
            if not 0 <= i < len(items) or (name, i) in seen:
                return
            seen.add((name, i))
            item = items[i]
            if name == "sections":
                for ref in item.get("elements", ()):
                    if m := re.fullmatch(r"/(\w+)/(\d+)", ref):
                        emit(m[1], int(m[2]), depth + (m[1] == "sections"))
                return
            page = int(item["boundingRegions"][0]["pageNumber"]) if item.get("boundingRegions") else 1
            caption = (item.get("caption") or {}).get("content")
            if name == "paragraphs":
                out.append({"role": item.get("role") or "text", "content": item.get("content", ""), "page": page, "depth": depth})
            elif name == "tables":
                grid = [[""] * item["columnCount"] for _ in range(item["rowCount"])]
                for cell in item["cells"]:
                    grid[cell["rowIndex"]][cell["columnIndex"]] = cell.get("content", "")
                parts = split_rows([str(i) for i in range(item["columnCount"])], grid, self.most, self.count)
                out.append({"role": "table", "content": [p + ("\n" + caption if caption else "") for p in parts], "page": page, "depth": depth})
            elif name == "figures" and caption:
                out.append({"role": "figure", "content": caption, "page": page, "depth": depth})

        inner = {int(m[1]) for s in sections for ref in s.get("elements", ()) if (m := re.fullmatch(r"/sections/(\d+)", ref))}
        # sections that refer to each other in a circle have no root: the first one is
        for i in [i for i in range(len(sections)) if i not in inner] or range(min(1, len(sections))):
            emit("sections", i, 1)
        for i, p in enumerate(raw.get("paragraphs") or ()):
            if p.get("role") in self.RANK:
                emit("paragraphs", i, 0)
        return sorted(out, key=lambda b: (b["page"], self.RANK.get(b["role"], 1)))

    def convert(self, raw: str) -> dict:
        data = json.loads(raw)
        blocks = self._blocks(data)
        out, top_seen, i = Canonical(), False, 0
        while i < len(blocks):
            b = blocks[i]
            role, page = b["role"], b["page"]
            kin = {"pageHeader": ("pageHeader",), "pageFooter": ("pageFooter", "pageNumber"), "pageNumber": ("pageFooter", "pageNumber")}.get(role, ())
            j = i + 1
            while kin and j < len(blocks) and blocks[j]["page"] == page and blocks[j]["role"] in kin:
                j += 1
            run, level, text = blocks[i:j], 0, b["content"]
            last = j == len(blocks)
            after = None if last or blocks[j]["page"] != page else blocks[j]
            if role == "pageHeader":
                text = f"<!-- PageHeader: {' '.join(x['content'].strip() for x in run)} -->\n\n"
            elif kin:
                said = [x["content"] for x in run if x["role"] == "pageFooter"] + ["page " + x["content"] for x in run if x["role"] == "pageNumber"]
                text = f"<!-- PageFooter: {' '.join(said)} -->\n"
            elif role == "table":
                for part in b["content"][:-1]:
                    out.add(page, f"<Table>\n{part}\n</Table>\n\n", True)
                text = f"<Table>\n{b['content'][-1]}\n</Table>\n\n"
            elif role in ("figure", "formulaBlock"):
                name = "Figure" if role == "figure" else "Formula"
                text = f"<{name}>\n{text}\n</{name}>\n\n"
            elif role in ("title", "sectionHeading"):
                top_seen = top_seen or b["depth"] == 1
                level = b["depth"] if top_seen else max(1, b["depth"] - 1)
                text = "#" * level + f" {text}\n\n"
            else:
                text = ("\\* " if role == "footnote" else "") + text + "\n\n"
            small = lambda x: x["role"] == "text" and self.count(x["content"]) < SHORT_BLOCK
            joins = level > 0 or after is not None and (after["role"] == "footnote" or small(b) and small(after))
            out.add(page, text, role == "table" or not joins, level)
            if after is None:
                out.add(page, PAGE_BREAK, not last)
            i = j
        return out.done(len(data.get("pages") or ()))


class ItemsParser:
    """Libraries that give labelled items in reading order: [{label, text, page, level?}], tables as markdown."""

    pattern = "*.pdf"

    def __init__(self, analyze: Callable[[bytes], str] | None = None, most: int = 1000, count: Counter = count_words) -> None:
        self.analyze, self.most, self.count = analyze, most, count

    def scan(self, content: bytes) -> str:
        if self.analyze is None:
            raise RuntimeError("a parsing library is needed: ItemsParser(analyze=...)")
        return self.analyze(content)

    def convert(self, raw: str) -> dict:
        items, out = json.loads(raw), Canonical()
        wraps = {"page_header": ("<!-- PageHeader: ", " -->\n\n"), "page_footer": ("<!-- PageFooter: ", " -->\n"), "caption": ("<Figure>\n", "\n</Figure>\n\n"), "formula": ("<Formula>\n", "\n</Formula>\n\n"), "footnote": ("\\* ", "\n\n")}
        for k, item in enumerate(items):
            label, page, text, level = item["label"], int(item.get("page", 1)), item.get("text", ""), 0
            after = items[k + 1] if k + 1 < len(items) else None
            if label == "table":
                for part in split_table_text(text, self.most, self.count):
                    out.add(page, f"<Table>\n{part}\n</Table>\n\n", True)
            else:
                if label in ("title", "section_header"):
                    level = int(item.get("level", 1))
                    text = "#" * level + f" {text}\n\n"
                else:
                    before, behind = wraps.get(label, ("", "\n\n"))
                    text = before + text + behind
                small = label not in wraps and self.count(text) < SHORT_BLOCK
                out.add(page, text, not (level or label == "footnote" or small), level)
            if after is not None and int(after.get("page", 1)) != page:
                out.add(page, PAGE_BREAK, True)
        return out.done()


class PagesParser:
    """Libraries that give a markdown text a page: ["text", ...] or [{text}, ...]. Headings are those of the markdown; a block is a page."""

    pattern = "*.pdf"
    HEADING = re.compile(r"^(#{1,6})\s+(.+)")

    def __init__(self, analyze: Callable[[bytes], str] | None = None) -> None:
        self.analyze = analyze

    def scan(self, content: bytes) -> str:
        if self.analyze is None:
            raise RuntimeError("a parsing library is needed: PagesParser(analyze=...)")
        return self.analyze(content)

    def convert(self, raw: str) -> dict:
        pages, out = json.loads(raw), Canonical()
        for n, page in enumerate(pages, 1):
            for line in re.split(r"(?<=\n)", page["text"] if isinstance(page, dict) else page):
                m = self.HEADING.match(line)
                out.add(n, line, False, len(m[1]) if m else 0)
            out.add(n, PAGE_BREAK if n < len(pages) else "", n < len(pages))
        return out.done(len(pages))


class ExcelParser:
    """Workbooks: blank rows separate tables, whose first row is the header; a sheet is a page. Read from the file's XML."""

    pattern = "*.xlsx"
    NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}

    def __init__(self, most: int = 1100, count: Counter = count_words) -> None:
        self.most, self.count = most, count

    def scan(self, content: bytes) -> str:
        """Raw form: [{sheet, rows}]."""
        ns = self.NS
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = set(z.namelist())
            shared = []
            if "xl/sharedStrings.xml" in names:
                shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
            book = ElementTree.fromstring(z.read("xl/workbook.xml"))
            links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            out = []
            for sheet in book.find("m:sheets", ns):
                target = links[sheet.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")].lstrip("/")
                root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
                rows: list[list[str]] = []
                for row in root.iter(f"{{{ns['m']}}}row"):
                    at = int(row.get("r", len(rows) + 1))
                    rows += [[] for _ in range(at - 1 - len(rows))]
                    cells: list[str] = []
                    for c in row.findall("m:c", ns):
                        letters = re.match(r"[A-Z]+", c.get("r", ""))
                        place = _column(letters[0]) if letters else len(cells)
                        cells += [""] * (place - len(cells))
                        value = c.find("m:v", ns)
                        if c.get("t") == "s" and value is not None:
                            cells.append(shared[int(value.text)])
                        elif c.get("t") == "inlineStr":
                            cells.append("".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")))
                        else:
                            cells.append(value.text if value is not None and value.text else "")
                    rows.append(cells)
                out.append({"sheet": sheet.get("name"), "rows": rows})
        return json.dumps(out)

    def convert(self, raw: str) -> dict:
        sheets, out = json.loads(raw), Canonical()
        for n, sheet in enumerate(sheets, 1):
            tables: list[list[list[str]]] = [[]]
            for row in sheet["rows"]:
                if any(c.strip() for c in row):
                    tables[-1].append(row)
                elif tables[-1]:
                    tables.append([])
            tables = [t for t in tables if t]
            for table in tables:
                header = clean_header(table[0], max(map(len, table)))
                parts = split_rows(header, table[1:], self.most, self.count)
                for k, part in enumerate(parts, 1):
                    name = sheet["sheet"] + (f" - part {k}" if len(parts) > 1 else "")
                    out.add(n, f"# {name}\n\n", False, 1)
                    out.add(n, part + "\n\n", True)
            out.add(n, PAGE_BREAK, True)
        return out.done(len(sheets))


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def clean_header(names: list[str], width: int) -> list[str]:
    """Blank names become col_i, repeated ones get a number."""
    out: list[str] = []
    for i, name in enumerate([*names, *[""] * (width - len(names))]):
        name = name.strip()
        base = name if name and name.lower() != "nan" else f"col_{i}"
        k, name = 1, base
        while name in out:
            name, k = f"{base}_{k}", k + 1
        out.append(name)
    return out


class HtmlPageParser(HTMLParser):
    """HTML as the offline stand-in: headings, blocks, tables, page breaks at ``<hr>``."""

    pattern = "*.html"
    HIDDEN = {"script", "style", "noscript", "template", "head", "nav", "footer", "aside", "form"}
    BLOCKS = {"p", "li", "blockquote", "pre", "figcaption", "dt", "dd", "div", "section", "article", "main", "body", "header", "ul", "ol", "table"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)

    def scan(self, content: bytes) -> str:
        return content.decode("utf-8", "replace")

    def convert(self, raw: str) -> dict:
        self.reset()
        self.out, self.page, self.held, self.level, self.depth, self.rows, self.cell = Canonical(), 1, [], 0, 0, None, None
        self.feed(raw)
        self.close()
        self._flush()
        return self.out.done()

    def _flush(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held = []
        if text:
            self.out.add(self.page, "#" * self.level + (" " if self.level else "") + text + "\n\n", not self.level, self.level)

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self._flush()
            self.depth += 1
        elif re.fullmatch(r"h[1-6]", tag):
            self._flush()
            self.level = int(tag[1])
        elif tag == "hr" and not self.depth:
            self._flush()
            self.out.add(self.page, PAGE_BREAK, True)
            self.page += 1
        elif tag == "table":
            self._flush()
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append("")
            self.cell = True
        elif tag == "br":
            self.held.append(" ")
        elif tag in self.BLOCKS:
            self._flush()

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.held = []
            self.depth = max(0, self.depth - 1)
        elif re.fullmatch(r"h[1-6]", tag):
            self._flush()
            self.level = 0
        elif tag == "table" and self.rows is not None:
            rows, self.rows, self.cell = [r for r in self.rows if r], None, None
            if rows and not self.depth:
                self.out.add(self.page, f"<Table>\n{markdown_table(rows)}\n</Table>\n\n", True)
        elif tag in ("td", "th"):
            self.cell = None
        elif tag in self.BLOCKS and self.rows is None:
            self._flush()

    def handle_data(self, data):
        if self.depth:
            return
        if self.rows is not None:
            if self.cell and self.rows and self.rows[-1]:
                self.rows[-1][-1] += " ".join(data.split())
        else:
            self.held.append(data)


def _converter(make_parser: Callable[[], Parser], scan: bool):
    def make():
        parser = make_parser()

        def work(value):
            try:
                doc = parser.convert(parser.scan(bytes(value)) if scan else value)
                return doc["pages"], doc["full_text"], doc["split_points"], doc["titles"], None
            except Exception as e:  # noqa: BLE001  a document that can't be parsed must not end the job
                return None, None, None, None, f"{type(e).__name__}: {e}"

        return work

    return make


def convert(raw: DataFrame, make_parser: Callable[[], Parser], content: Column | None = None, scan: bool = False) -> DataFrame:
    """(doc_name, document_name, pages, full_text, split_points, titles, error) of rows (doc_name, raw); what fails has an error and nulls."""
    found = add_columns(raw.select("doc_name", (F.col("raw") if content is None else content).alias("raw")), [F.col("raw")], CANONICAL, _converter(make_parser, scan))
    return found.select("doc_name", F.col("doc_name").alias("document_name"), "pages", "full_text", "split_points", "titles", "error")


def parse_directory(spark: SparkSession, path: str, make_parser: Callable[[], Parser], done: DataFrame | None = None) -> DataFrame:
    """Files of the parser's pattern below a path, parsed; documents in ``done`` are skipped."""
    return convert(readers.binary_files(spark, path, make_parser().pattern, done).withColumnRenamed("content", "raw"), make_parser, scan=True)


def parse_pages(pages: DataFrame, make_parser: Callable[[], Parser] = HtmlPageParser) -> DataFrame:
    """Documents of the ``pages`` table (page_id, html)."""
    return convert(pages.select(F.col("page_id").cast("string").alias("doc_name"), F.coalesce("html", F.lit("")).alias("raw")), make_parser)


def registered() -> Iterable[str]:
    return ("layout", "items", "pages", "excel", "html")
