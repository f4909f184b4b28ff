"""Files to typed elements: guard, sniffing and parsers, one row per element; a bad file is a row with an error."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from fnmatch import fnmatch
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pdf

MAX_MB = 50
ELEMENT = "path string, kind string, seq int, element string, level int, text string, section_path array<string>, page int, error string"
# Extensions by kind, the fence names of code where they are not the extension, magic bytes, definition lines.
TEXTLIKE = ".txt .md .markdown .rst .log .text".split()
IMAGE = ".png .jpg .jpeg .bmp .tiff .webp".split()
CODE = ".py .js .ts .tsx .java .go .rs .c .h .cpp .cc .cs .rb .php .sh .sql .scala .kt .swift .r .m .lua".split()
SHEET = ".csv .xlsx .xls .tsv".split()
FENCES = {".py": "python", ".js": "javascript", ".ts": "typescript", ".rs": "rust", ".h": "c", ".cc": "cpp", ".cs": "csharp", ".rb": "ruby", ".sh": "bash", ".kt": "kotlin", ".m": "matlab"}
MAGIC = ((b"%PDF-", "pdf"), (b"\x89PNG\r\n\x1a\n", "image"), (b"\xff\xd8\xff", "image"), (b"GIF8", "image"), (b"BM", "image"), (b"PK\x03\x04", "zip"))
DEFINES = re.compile(r"^[ \t]*(?:def |class |func |function |public |private |protected |fn |async def |export function |export default function )")


def sniff(head: bytes) -> str:
    """pdf, image or zip by magic bytes; text if over 85 % is printable ASCII; else none."""
    for magic, kind in MAGIC:
        if head.startswith(magic):
            return kind
    head = head[:2048]
    good = sum(32 <= b < 127 or b in (9, 10, 13) for b in head)
    return "text" if head and good > 0.85 * len(head) else "none"


def extension(name: str) -> str:
    return "." + name.rpartition(".")[2].lower() if "." in name else ""


def kind_of(name: str, head: bytes) -> str | None:
    ext = extension(name)
    seen = sniff(head)
    if seen == "pdf" or (seen == "image" and ext not in CODE):
        return seen
    by_ext = {".pdf": "pdf", ".docx": "docx", ".pptx": "pptx", ".html": "html", ".htm": "html"} | {e: "image" for e in IMAGE} | {e: "code" for e in CODE} | {e: "sheet" for e in SHEET} | {e: "text" for e in TEXTLIKE}
    return by_ext.get(ext) or {"zip": "docx", "text": "text"}.get(seen)


def kinds(files: DataFrame, id_col: str = "path") -> DataFrame:
    """id_col and kind (null: unrecognised) of rows (id_col, name, content), as the readers are chosen."""
    kind = files.schema[id_col].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [kind_of(n or "", bytes(x or b"")) for n, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], [id_col, "kind"])

    return files.select(id_col, "name", F.substring("content", 1, 2048).alias("content")).mapInArrow(apply, f"`{id_col}` {kind}, kind string")


def route(name: Column) -> Column:
    """Where a file goes by its extension: spreadsheet, code, image or document."""
    ext = F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    return F.when(ext.isin(SHEET), "spreadsheet").when(ext.isin(CODE), "code").when(ext.isin(IMAGE), "image").otherwise("document")


def guard(name: str, size: int, max_mb: int = MAX_MB) -> str | None:
    """Why a file is refused, or None."""
    return "empty file" if not size else f"larger than {max_mb} MB" if size > max_mb << 20 else None


def guard_column(length: Column, most: int = MAX_MB << 20) -> Column:
    """guard over a column of lengths in bytes."""
    return F.when(length == 0, "empty file").when(length > most, f"larger than {most} bytes")


def sniffed(files: DataFrame, id_col: str = "path") -> DataFrame:
    """id_col and sniff of rows (id_col, content); a null content is none."""
    kind = files.schema[id_col].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sniff(bytes(x or b"")) for x in b.column(1).to_pylist()], pa.string())], [id_col, "kind"])

    # magic bytes and the printable share are judged on the head alone
    return files.select(id_col, F.substring("content", 1, 2048).alias("content")).mapInArrow(apply, f"`{id_col}` {kind}, kind string")


def parse_text(text: str, markdown: bool = True) -> Iterator[tuple[str, int | None, str]]:
    """(element, level, text): headings by # or underline, fenced code, paragraphs; in plain text also short
    numbered or upper-case lines before an empty one. Front matter between --- lines is skipped."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if markdown and lines[0].strip() == "---" and "---" in [x.strip() for x in lines[1:]]:
        lines = lines[[x.strip() for x in lines[1:]].index("---") + 2 :]
    block: list[str] = []
    fence: list[str] | None = None
    for i, line in enumerate(lines):
        bare = line.strip()
        if bare.startswith("```"):
            if fence is None:
                yield from _paragraph(block)
                fence = [line]
            else:
                yield "code", None, "\n".join([*fence, line])
                fence = None
        elif fence is not None:
            fence.append(line)
        elif markdown and (m := re.match(r"#{1,6}", bare)):
            yield from _paragraph(block)
            yield "heading", len(m[0]), bare.lstrip("#").strip()
        elif markdown and block and re.fullmatch(r"=+|-{2,}", bare):
            title = block.pop()
            yield from _paragraph(block)
            yield "heading", 1 if bare[0] == "=" else 2, title.strip()
        elif not bare:
            yield from _paragraph(block)
        elif not markdown and not block and len(bare) < 70 and (i + 1 == len(lines) or not lines[i + 1].strip()) and (re.match(r"\d+(\.\d+)*\.?\s+\S", bare) or (bare.isupper() and len(bare) > 3)):
            yield "heading", 2 if bare[0].isdigit() else 1, bare
        else:
            block.append(line)
    yield from _paragraph([*block, *(fence or [])])


def _paragraph(block: list[str]) -> Iterator[tuple[str, None, str]]:
    body = re.sub("[ \t]+", " ", "\n".join(block)).strip()
    block.clear()
    if body:
        yield "paragraph", None, body


class _Html(HTMLParser):
    """HTML as Markdown lines: headings, list items, table rows; no scripts or styles."""

    def __init__(self):
        super().__init__()
        self.out: list[str] = []
        self.hidden = 0
        self.links: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.hidden += tag != "head"
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("td", "th"):
            self.out.append(" | ")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[" if self.links[-1] else "")
        elif tag in ("p", "div", "table", "ul", "ol", "article", "nav", "footer", "section", "title"):
            self.out.append("\n\n")
        elif tag in ("tr", "br", "li"):
            self.out.append("\n- " if tag == "li" else "\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "a" and self.links:
            href = self.links.pop()
            self.out.append(f"]({href})" if href else "")
        elif re.fullmatch("h[1-6]|p|div|table|title", tag):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(re.sub(r"\s+", " ", data))


def html_text(html: str) -> str:
    p = _Html()
    p.feed(html)
    return re.sub("\n{3,}", "\n\n", "".join(p.out)).strip()


def parse_code(text: str) -> Iterator[tuple[str, int | None, str]]:
    """Segments that begin at unindented definitions; what stands before the first is one too."""
    part: list[str] = []
    for line in text.split("\n"):
        if DEFINES.match(line) and not line[:1].isspace() and any(x.strip() for x in part):
            yield "code", None, "\n".join(part).strip("\n")
            part = []
        part.append(line)
    if any(x.strip() for x in part):
        yield "code", None, "\n".join(part).strip("\n")


def parse_office(data: bytes) -> Iterator[tuple[str, int | None, str]]:
    """Paragraphs and tables of a word file in order, or of a deck's slides with titles and charts; heading styles are headings."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        if "word/document.xml" in names:
            yield from _blocks(ElementTree.fromstring(z.read("word/document.xml")))
            return
        slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for name in slides:
            yield from _blocks(ElementTree.fromstring(z.read(name)))
            rels = name.replace("slides/", "slides/_rels/") + ".rels"
            for rel in ElementTree.fromstring(z.read(rels)) if rels in names else ():
                part = "ppt/" + rel.get("Target", "").removeprefix("../").removeprefix("/ppt/")
                if "/charts/" in part and part in names and (body := chart(ElementTree.fromstring(z.read(part)))):
                    yield "table", None, body


def _tag(e) -> str:
    return e.tag.rpartition("}")[2]


def _words(e) -> str:
    return "".join(t.text or "" for t in e.iter() if _tag(t) == "t").strip()


def _blocks(e, title: bool = False) -> Iterator[tuple[str, int | None, str]]:
    for x in e:
        tag = _tag(x)
        if tag == "tbl":
            if body := markdown_table([[_words(c) for c in r if _tag(c) == "tc"] for r in x if _tag(r) == "tr"]):
                yield "table", None, body
        elif tag == "p":
            text = _words(x)
            style = next((v for s in x.iter() if _tag(s) == "pStyle" for v in s.attrib.values()), "")
            m = re.match(r"(?:Heading|Title)(\d*)", style)
            if text and (m or title):
                yield "heading", int(m[1] or 1) if m else 1, text
            elif text:
                yield "list_item" if style.startswith("List") else "paragraph", None, text
        else:
            holder = next((p for p in x.iter() if _tag(p) == "ph"), None) if tag == "sp" else None
            yield from _blocks(x, title or (holder is not None and holder.get("type") in ("title", "ctrTitle")))


def figure(x: str | None) -> str:
    """A number with thousands marks and at most two places; other text as it is."""
    try:
        return f"{float(x):,.2f}".rstrip("0").rstrip(".")
    except (TypeError, ValueError):
        return x or ""


def chart(root) -> str | None:
    """A chart part as a Markdown table: a row for each category, a column for each series."""
    points = lambda e, kind: {int(p.get("idx")): next((v.text for v in p if _tag(v) == "v"), None) for k in e if _tag(k) == kind for p in k.iter() if _tag(p) == "pt"}
    series = [(points(s, "tx").get(0) or f"Series {i}", points(s, "cat"), points(s, "val")) for i, s in enumerate((s for s in root.iter() if _tag(s) == "ser"), 1)]
    if not series:
        return None
    categories = max((c for _, c, _ in series), key=len)
    return markdown_table([["Category", *(n for n, _, _ in series)], *([categories[k], *(figure(v.get(k)) for _, _, v in series)] for k in sorted(categories))])


def charts(parts: DataFrame, id_col: str = "id") -> DataFrame:
    """id_col and text, the Markdown table, of chart parts (id_col, xml)."""
    kind = parts.schema[id_col].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([chart(ElementTree.fromstring(x)) if x else None for x in b.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return parts.select(id_col, "xml").mapInArrow(apply, f"`{id_col}` {kind}, text string")


def delimited(data: bytes, name: str) -> tuple[str, str, str]:
    """Text, encoding and separator of a delimited file; the first encoding that fits is taken."""
    for coding in ("utf-8-sig", "utf-8", "cp1252", "latin-1"):
        try:
            text = data.decode(coding)
            break
        except UnicodeDecodeError:
            continue
    first = text.split("\n", 1)[0]
    return text, coding, "\t" if name.lower().endswith(".tsv") else max(",;\t|", key=first.count)


def _column(ref: str) -> int:
    """0-based column of a cell reference such as AB12."""
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def workbook(data: bytes) -> Iterator[tuple[str, list[list[str | None]]]]:
    """(sheet name, rows) of a workbook; cells are strings or None, rows are as wide as the widest."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        text = lambda e: "".join(t.text or "" for t in e.iter() if t.tag.endswith("}t"))
        shared = [text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if e.tag.endswith("}si")] if "xl/sharedStrings.xml" in names else []
        link = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in (e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if e.tag.endswith("}sheet")):
            target = link[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
            rows: list[dict[int, str | None]] = []
            for row in (e for e in ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter() if e.tag.endswith("}row")):
                cells: dict[int, str | None] = {}
                for c in row:
                    value = next((v.text for v in c if v.tag.endswith("}v")), None)
                    kind = c.get("t")
                    cells[_column(c.get("r")) if c.get("r") else len(cells)] = text(c) if kind == "inlineStr" else shared[int(value)] if kind == "s" and value else value
                rows.append(cells)
            width = max((max(r) + 1 for r in rows if r), default=0)
            yield sheet.get("name"), [[r.get(i) for i in range(width)] for r in rows]


def markdown_table(rows: list[list[str | None]], most_columns: int = 40, most_rows: int = 400, most_chars: int = 300) -> str | None:
    """Rows as Markdown; pipes escaped, blank rows dropped; None below two rows. The limits are the format's."""
    cell = lambda c: re.sub(r"\s+", " ", c or "").strip()[:most_chars].replace("|", "\\|")
    lines = ["| " + " | ".join(map(cell, r[:most_columns])) + " |" for r in rows[:most_rows] if any((c or "").strip() for c in r)]
    return "\n".join(lines) if len(lines) > 1 else None


def parse_sheet(data: bytes, name: str) -> Iterator[tuple[str, int | None, str]]:
    """A delimited file as one Markdown table (rows of another width are skipped), or one for each sheet of a workbook."""
    if data.startswith(b"PK"):
        for sheet, rows in workbook(data):
            yield "heading", 1, sheet
            if body := markdown_table(rows):
                yield "table", None, body
        return
    text, _, sep = delimited(data, name)
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=sep) if r]
    if body := markdown_table([r for r in rows if len(r) == len(rows[0])]):
        yield "table", None, body


def title(name: str, found: list[tuple]) -> str:
    """The first heading, else the file's name without its extension."""
    return next((x[2] for x in found if x[0] in ("heading", "title")), name.rpartition(".")[0] or name)


def titles(found: DataFrame) -> DataFrame:
    """path and title of elements: each file's first heading, else its name without the extension."""
    first = F.min_by("text", F.when(F.col("element").isin("heading", "title"), F.col("seq")))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    return found.groupBy("path").agg(first.alias("_first")).select("path", F.coalesce("_first", stem).alias("title"))


def parse(name: str, data: bytes) -> tuple[str, list[tuple]]:
    """Kind and elements (element, level, text, and the page where there are pages)."""
    if why := guard(name, len(data)):
        raise ValueError(why)
    kind = kind_of(name, data)
    if kind is None:
        raise ValueError(f"unrecognised file type: {name}")
    if kind == "sheet":
        return kind, list(parse_sheet(data, name))
    if kind in ("docx", "pptx"):
        return kind, list(parse_office(data))
    if kind == "pdf":  # a page without text, as a scan, is not read
        return kind, list(pdf.elements(data)) or [("figure", None, f"[{kind}: {name}]", 1)]
    if kind == "image":  # a reader for images is not installed
        return kind, [("figure", None, f"[{kind}: {name}]")]
    text = data.decode("utf-8", "replace")
    if kind == "html":
        return kind, list(parse_text(html_text(text)))
    if kind == "code":
        fence = FENCES.get(extension(name), extension(name)[1:])
        return kind, [(e, level, f"```{fence}\n{part}\n```") for e, level, part in parse_code(text)]
    return kind, list(parse_text(text, name.lower().endswith((".md", ".markdown"))))


def elements(files: DataFrame) -> DataFrame:
    """binaryFile rows (path, content) to elements; failures carry the error and no text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    kind, found = parse(path.rsplit("/", 1)[-1], bytes(data or b""))
                except Exception as e:  # a bad file is a row, not a failed job
                    rows.append((path, None, 0, None, None, None, [], None, str(e)[:300]))
                    continue
                trail: list[str] = []
                for i, (element, level, text, *page) in enumerate(found):
                    if element == "heading":
                        trail = [*trail[: level - 1], text]
                    elif kind == "code":  # a segment's path is the line that defines it
                        head = text.split("\n")[1]
                        trail = [head.strip()[:80]] if DEFINES.match(head) else []
                    rows.append((path, kind, i, element, level, text, trail, page[0] if page else None, None))
            types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.string())
            cols = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["path", "kind", "seq", "element", "level", "text", "section_path", "page", "error"])

    return files.select("path", "content").mapInArrow(apply, ELEMENT)


def read(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Elements of all files below a folder. Files above the limit and empty ones are rows with an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    found = elements(files.where(F.col("length") <= MAX_MB << 20))
    large = files.where(F.col("length") > MAX_MB << 20).select("path", F.lit(guard("", (MAX_MB << 20) + 1)).alias("error"))
    refused = large.unionByName(spark.createDataFrame([(p, guard("", 0)) for p in empty_files(spark, path, pattern)], "path string, error string"))
    rows = refused.selectExpr("path", "CAST(NULL AS STRING) AS kind", "0 AS seq", "CAST(NULL AS STRING) AS element", "CAST(NULL AS INT) AS level", "CAST(NULL AS STRING) AS text", "CAST(array() AS array<string>) AS section_path", "CAST(NULL AS INT) AS page", "error")
    return found.unionByName(rows)


def _listing(spark: SparkSession, path: str, pattern: str) -> Iterator[tuple[str, int]]:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True)
    while found.hasNext():
        f = found.next()
        if fnmatch(f.getPath().getName(), pattern):
            yield f.getPath().toString(), f.getLen()


def listed(spark: SparkSession, path: str, pattern: str = "*") -> list[str]:
    """Names of the files below a folder."""
    return [name for name, _ in _listing(spark, path, pattern)]


def empty_files(spark: SparkSession, path: str, pattern: str = "*") -> list[str]:
    """Files without bytes, which Spark's file sources leave out of their scans; names only."""
    return [name for name, size in _listing(spark, path, pattern) if not size]
