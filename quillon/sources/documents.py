"""Documents of many kinds to one line of text each: HTML, RTF, TEI, PDF, and whatever a decoder is given for."""

from __future__ import annotations

import mimetypes
import re
import subprocess
import tempfile
import zlib
from collections.abc import Callable, Collection, Iterator, Mapping, Sequence
from html.parser import HTMLParser
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quillon.functions import text as T
from quillon.sources.lines import guess_encoding

Decoder = Callable[[bytes], str]
STRUCK = ("s", "strike", "del", "table")
_SILENT = frozenset({"script", "style", "head", "noscript", "template", "svg", "iframe"})
_ASIDE = frozenset({"nav", "header", "footer", "aside", "form", "menu"})
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset("p div br li tr td th h1 h2 h3 h4 h5 h6 section article blockquote pre ul ol table main dd dt".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}}


class _Text(HTMLParser):
    """Text outside of what is dropped; unclosed tags are closed by those around them."""

    def __init__(self, dropped: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.dropped, self.open, self.depth, self.parts = dropped, [], 0, []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in _BLOCK:
            self.parts.append(" ")
        if tag in _VOID:
            return
        if tag in _CLOSES and self.open and self.open[-1] in _CLOSES[tag]:
            self.handle_endtag(self.open[-1])
        self.open.append(tag)
        self.depth += tag in self.dropped

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag in _BLOCK:
            self.parts.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while self.open:
                last = self.open.pop()
                self.depth -= last in self.dropped
                if last == tag:
                    break
        if tag in _BLOCK:
            self.parts.append(" ")

    def handle_data(self, data: str) -> None:
        if not self.depth:
            self.parts.append(data)


def html_text(html: str, struck: Collection[str] | None = STRUCK, whole: bool = False) -> str:
    """Text of a page in one line. ``whole`` keeps navigation, headers and footers too; ``struck`` tags go (None: none do)."""
    parser = _Text(_SILENT | frozenset(struck or ()) | (frozenset() if whole else _ASIDE))
    parser.feed(html)
    parser.close()
    return re.sub(r"\s+", " ", "".join(parser.parts)).strip()


def html_column(html: Column | str, struck: Collection[str] | None = STRUCK, whole: bool = False) -> Column:
    """``html_text`` of a column, in Arrow batches; null stays null."""

    @pandas_udf("string")
    def convert(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: None if h is None else html_text(h, struck, whole))

    return convert(html)


def strip_tags(html: Column | str) -> Column:
    """Tags, comments, scripts and styles taken out by pattern, in the JVM: faster, without regard to structure."""
    own = F.col(html) if isinstance(html, str) else html
    silent = F.regexp_replace(own, r"(?is)<(script|style)\b.*?</(script|style)\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(silent, r"(?s)<[^>]*>", " "), r"\s+", " "))


_RTF = re.compile(r"\\([a-z]{1,32})(-?\d{1,10})?[ ]?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|(.)", re.I | re.S)
_RTF_SKIP = frozenset("fonttbl colortbl stylesheet info pict header footer headerl headerr footerl footerr footnote object themedata listtable listoverridetable generator datastore".split())


def rtf_text(data: bytes | str) -> str:
    """Plain text of a rich text file in one line."""
    source = data if isinstance(data, str) else data.decode("latin-1")
    out: list[str] = []
    stack: list[tuple[bool, int]] = []
    skip, unicode_skip, left = False, 1, 0
    for m in _RTF.finditer(source):
        word, number, code, sign, brace, char = m.groups()
        if brace == "{":
            stack.append((skip, unicode_skip))
        elif brace == "}":
            skip, unicode_skip = stack.pop() if stack else (False, 1)
        elif sign == "*":
            skip = True
        elif sign:
            if not skip:
                out.append({"~": "\xa0", "_": "-"}.get(sign, sign if sign in "{}\\" else ""))
        elif word:
            low = word.lower()
            if low in _RTF_SKIP:
                skip = True
            elif low == "uc":
                unicode_skip = int(number or 1)
            elif skip:
                continue
            elif low in ("par", "line", "tab", "cell", "row", "sect", "page"):
                out.append(" ")
            elif low == "u" and number:
                out.append(chr(int(number) % 65536))
                left = unicode_skip
            elif low in ("emdash", "endash", "lquote", "rquote", "ldblquote", "rdblquote", "bullet"):
                out.append({"emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}[low])
        elif code is not None or char is not None:
            if left:
                left -= 1
            elif not skip:
                out.append(bytes([int(code, 16)]).decode("cp1252", "replace") if code is not None else char)
    text = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return re.sub(r"\s+", " ", text).strip()


def tei_texts(data: bytes | str, tags: Sequence[str] = ("text",), subtags: Sequence[str] = ()) -> list[str]:
    """Texts of the elements ``tags`` in document order; of ``subtags`` inside each, a subtag after another. Nested hits repeat."""
    if not tags:
        raise ValueError("at least one tag is needed")
    root = ElementTree.fromstring(data)
    local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    text = lambda e: "".join(s.strip() for s in e.itertext())
    out = []
    for e in root.iter():
        if local(e) in tags:
            out += [text(x) for s in subtags for x in e.iter() if x is not e and local(x) == s] if subtags else [text(e)]
    return out


def tei_text(data: bytes | str, tags: Sequence[str] = ("text",), subtags: Sequence[str] = (), sep: str = " ") -> str:
    return re.sub(r"\s+", " ", sep.join(tei_texts(data, tags, subtags)))


_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)endobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)


def _pdf_objects(data: bytes) -> dict[int, tuple[bytes, bytes]]:
    """(dictionary, decoded stream) by number, those inside object streams too."""
    out: dict[int, tuple[bytes, bytes]] = {}
    for number, _, body in _OBJECT.findall(data):
        m = _STREAM.search(body)
        head, raw = (body[: m.start()], m.group(1)) if m else (body, b"")
        if b"FlateDecode" in head:
            raw = zlib.decompressobj().decompress(raw)
        out[int(number)] = (head, raw)
        if b"/ObjStm" in head:
            first, n = int(re.search(rb"/First\s+(\d+)", head)[1]), int(re.search(rb"/N\s+(\d+)", head)[1])
            places = list(map(int, raw[:first].split()[: 2 * n]))
            for k in range(n):
                end = places[2 * k + 3] if k + 1 < n else len(raw) - first
                out[places[2 * k]] = (raw[first + places[2 * k + 1] : first + end], b"")
    return out


def _pdf_pages(objects: dict[int, tuple[bytes, bytes]]) -> list[bytes]:
    """Dictionaries of the pages, in the order of the page tree."""
    roots = [n for n, (h, _) in objects.items() if re.search(rb"/Type\s*/Pages\b", h) and not re.search(rb"/Parent\b", h)]
    out: list[bytes] = []

    def walk(n: int, seen: frozenset[int]) -> None:
        head = objects.get(n, (b"", b""))[0]
        if n in seen:
            return
        if re.search(rb"/Type\s*/Page\b(?!s)", head):
            out.append(head)
        elif kids := re.search(rb"/Kids\s*\[(.*?)\]", head, re.S):
            for k in re.findall(rb"(\d+)\s+\d+\s+R", kids[1]):
                walk(int(k), seen | {n})

    for n in roots:
        walk(n, frozenset())
    return out or [h for _, (h, _) in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b(?!s)", h)]


def pdf_pages(data: bytes) -> int:
    return len(_pdf_pages(_pdf_objects(data)))


def pdf_valid(data: bytes) -> bool:
    """Whether it begins as a PDF and has a page that can be read."""
    try:
        return data[:1024].lstrip().startswith(b"%PDF-") and pdf_pages(data) > 0
    except (zlib.error, ValueError, TypeError, IndexError):
        return False


_SHOWN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|(-?\d+(?:\.\d+)?)(?=[^\[\]]*\]\s*TJ)|\b(T\*|Td|TD|Tj|TJ|ET)\b|'", re.S)


def pdf_text(data: bytes, start: int | None = None, end: int | None = None) -> str:
    """Text of pages [start, end) in one line, of documents whose fonts have a simple encoding; an ``end`` of 0 means all. Others need a decoder."""
    objects, out = _pdf_objects(data), []
    for head in _pdf_pages(objects)[start or 0 : end or None]:
        m = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", head, re.S)
        body = b"\n".join(objects.get(int(n), (b"", b""))[1] for n in re.findall(rb"(\d+)\s+\d+\s+R", m[1])) if m else b""
        for s in _SHOWN.finditer(body):
            own = s.group()
            if own[:1] == b"(":
                plain = re.sub(rb"\\([0-7]{1,3}|.)", lambda x: bytes([int(x[1], 8) & 255]) if x[1][:1].isdigit() else {b"n": b" ", b"r": b" ", b"t": b" "}.get(x[1], x[1]), own[1:-1], flags=re.S)
                out.append(plain.decode("latin-1"))
            elif own[:1] == b"<":
                digits = re.sub(rb"\s", b"", own[1:-1])
                out.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1"))
            elif s.group(1) and float(s.group(1)) < -200 or own in (b"T*", b"Td", b"TD", b"ET", b"'"):
                out.append(" ")
        out.append(" ")
    return re.sub(r"\s+", " ", "".join(out)).strip()


def external(command: Sequence[str], suffix: str, folder: str, out_suffix: str = ".txt", timeout: float = 600) -> Decoder:
    """A decoder that runs a program on a file; ``{in}`` and ``{dir}`` in its arguments stand for the file and the folder of its output.

    For word processors' files and character recognition: the program has to be on the executors.
    ``folder`` is one that all executors can write to; each record has its own in it while it is decoded.
    """

    def decode(data: bytes) -> str:
        with tempfile.TemporaryDirectory(dir=folder) as d:
            source = Path(d, "in" + suffix)
            source.write_bytes(data)
            done = subprocess.run([a.replace("{in}", str(source)).replace("{dir}", d) for a in command], capture_output=True, timeout=timeout, check=True)
            result = Path(d, "in" + out_suffix)
            raw = result.read_bytes() if result.exists() else done.stdout
        return re.sub(r"\s+", " ", raw.decode(guess_encoding(raw), "replace")).strip()

    return decode


def _decode_html(data: bytes) -> str:
    return html_text(data.decode(guess_encoding(data), "replace"))


#: By kind. Further kinds, such as ``application/msword`` and images, are given with ``external``.
DECODERS: dict[str, Decoder] = {"text/html": _decode_html, "application/xhtml+xml": _decode_html, "application/rtf": rtf_text, "text/rtf": rtf_text, "application/xml": tei_text, "text/xml": tei_text, "application/pdf": pdf_text}


def kind_of(path: str, data: bytes = b"") -> str | None:
    """The mime type of a file by its name, or by its first bytes where the name tells none."""
    kind = {".rtf": "application/rtf", ".xml": "application/xml"}.get(Path(path).suffix.lower()) or mimetypes.guess_type(path)[0]
    if kind or not data:
        return kind
    head = data[:512].lstrip().lower()
    for mark, name in ((b"%pdf-", "application/pdf"), (b"{\\rtf", "application/rtf"), (b"<!doctype html", "text/html"), (b"<html", "text/html"), (b"<?xml", "application/xml")):
        if head.startswith(mark):
            return name
    return None


def read_documents(spark: SparkSession, path: str | Sequence[str], decoders: Mapping[str, Decoder] | None = None, joiner: Callable[[str], str] | None = None) -> DataFrame:
    """``position INT, path, kind, text, error`` of a list of files in its order, or of all files below a folder in order of their paths.

    ``decoders`` adds to DECODERS, by mime type or by suffix; a suffix comes first. A file that can't be decoded or read has
    a null text and the error. ``joiner`` maps each text, such as one that joins spaced letters.
    """
    known = dict(DECODERS) | {k.lower(): v for k, v in (decoders or {}).items()}
    if isinstance(path, str):
        names = [r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").orderBy("path").toLocalIterator()]
    else:
        names = [p if "://" in p or p.startswith("file:") else Path(p).absolute().as_uri() for p in path]
    plain = lambda p: re.sub(r"^file:/+", "/", p)
    there = {p for p in set(names) if _exists(spark, p)}
    rows = [(i, p, plain(p)) for i, p in enumerate(names)]
    lost = spark.createDataFrame([(i, p) for i, p, _ in rows if p not in there], "position int, path string").withColumn("content", F.lit(None).cast("binary"))
    read = lost
    if there:
        # the list of names, which the driver has, is broadcast; contents stay where they are read
        order = F.broadcast(spark.createDataFrame([r for r in rows if r[1] in there], "position int, path string, _key string"))
        found = spark.read.format("binaryFile").load(sorted(there)).select(F.regexp_replace("path", "^file:/+", "/").alias("_key"), "content")
        read = found.join(order, "_key").select("position", "path", "content").unionByName(lost)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, p, data in zip(f["position"], f["path"], f["content"]):
                kind = None
                try:
                    if data is None:
                        raise FileNotFoundError(p)
                    data = bytes(data)
                    kind = kind_of(p, data)
                    decode = known.get(Path(p).suffix.lower()) or known.get(kind or "")
                    if decode is None:
                        raise ValueError(f"no decoder for {kind or 'files of unknown kind'}")
                    own = decode(data)
                    out.append((i, p, kind, joiner(own) if joiner else own, None))
                except Exception as e:  # a bad file must not end the job: the row says what is wrong
                    out.append((i, p, kind, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["position", "path", "kind", "text", "error"])

    return read.mapInPandas(run, "position int, path string, kind string, text string, error string")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_base64(df: DataFrame, data_col: str = "data") -> DataFrame:
    """The frame with base64 text decoded into bytes."""
    return df.withColumn(data_col, T.from_base64(data_col))
