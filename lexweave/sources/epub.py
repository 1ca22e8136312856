"""EPUB reading and writing with the standard library: one book is small, many books are many rows."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from ..functions.html import to_markdown

#: XML namespaces of the formats.
NS = {"c": "urn:oasis:names:tc:opendocument:xmlns:container", "o": "http://www.idpf.org/2007/opf", "d": "http://purl.org/dc/elements/1.1/", "n": "http://www.daisy.org/z3986/2005/ncx/", "x": "http://www.w3.org/1999/xhtml"}
STYLE = "body { line-height: 1.4; } #titlepage { text-align: center; } article { page-break-before: always; }"


def split_blocks(markdown: str) -> list[str]:
    return [p.strip() for p in markdown.split("\n\n") if p.strip()]


def heading_of(blocks: list[str]) -> str | None:
    """Title of an item: its first heading, else a first block of fewer than ten words without its marks."""
    for b in blocks:
        if b.startswith("#"):
            return re.sub(r"^#{1,6}", "", b).strip()
    if not blocks:
        return None
    lead = re.match(r'[^a-zA-Z\u0080-￿"]+', blocks[0])
    bare = blocks[0][lead.end() :] if lead else blocks[0]
    if lead:
        bare = re.sub(r'[^a-zA-Z\u0080-￿"]+\Z', "", bare)
    return bare if len(bare.split()) < 10 else None


def metadata_paragraphs(package: ElementTree.Element) -> list[str]:
    """Book id, title, authors, publisher, date, then the description's paragraphs; what is missing is 'Unknown'."""
    def values(name: str) -> list[str]:
        return [(e.text or "").strip() for e in package.findall(f".//d:{name}", NS) if (e.text or "").strip()]

    creators = values("creator")
    first = [next(iter(values(n)), "Unknown") for n in ("identifier", "title")]
    rest = [next(iter(values(n)), "Unknown") for n in ("publisher", "date")]
    out = [*first, ", ".join(creators) if creators else "Unknown", *rest]
    for d in values("description"):
        out += split_blocks(to_markdown(d) if d.startswith("<") else d)
    return out


def toc_links(archive: zipfile.ZipFile, names: list[str]) -> list[tuple[str, str]]:
    """(title, target) of every entry of the table of contents, nested ones after their parent."""
    for name in names:
        if name.endswith(".ncx"):
            tree = ElementTree.fromstring(archive.read(name))
            return [((p.findtext("n:navLabel/n:text", "", NS) or "").strip(), (p.find("n:content", NS).get("src") if p.find("n:content", NS) is not None else "")) for p in tree.iter(f"{{{NS['n']}}}navPoint")]
    return []


def read_epub(data: bytes) -> list[dict]:
    """Chapters of a book: metadata first, then the documents of the spine in order, numbered from 1."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("META-INF/container.xml")).find(".//c:rootfile", NS).get("full-path")
        package = ElementTree.fromstring(z.read(root))
        meta = metadata_paragraphs(package)
        chapters = [{"chapter": 0, "id": "metadata", "name": "000. metadata", "title": meta[1], "paragraphs": meta}]
        items = {i.get("id"): i for i in package.findall(".//o:manifest/o:item", NS)}
        for ref in package.findall(".//o:spine/o:itemref", NS):
            item = items.get(ref.get("idref"))
            if item is None or "html" not in (item.get("media-type") or ""):
                continue
            path = posixpath.normpath(posixpath.join(posixpath.dirname(root), item.get("href")))
            if path not in z.namelist() or "nav" in (item.get("properties") or "").split():
                continue
            blocks = split_blocks(to_markdown(z.read(path).decode("utf-8", "replace")) or "")
            if not blocks:
                continue
            title = heading_of(blocks)
            n = len(chapters)
            chapters.append({"chapter": n, "id": item.get("id"), "name": f"{n:03d}. {title or 'NO_TITLE'}", "title": title, "paragraphs": [title or item.get("id"), *blocks]})
        return chapters


def write_epub(identifier: str, title: str, author: str | None, language: str, chapters: list[tuple[str, str]]) -> bytes:
    """A book of (title, html body) chapters: title page, navigation and chapters in this order."""
    def page(name: str, body: str) -> str:
        return f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="{NS["x"]}" xml:lang="{language}"><head><title>{escape(name)}</title><link rel="stylesheet" href="style.css"/></head><body>{body}</body></html>'

    pages = [(f"chapter{n}.xhtml", t, page(t, f"<article>{b}</article>")) for n, (t, b) in enumerate(chapters, 1)]
    links = "".join(f'<li><a href="{f}">{escape(t)}</a></li>' for f, t, _ in pages)
    points = "".join(f'<navPoint id="n{i}" playOrder="{i}"><navLabel><text>{escape(t)}</text></navLabel><content src="{f}"/></navPoint>' for i, (f, t, _) in enumerate(pages, 1))
    items = "".join(f'<item id="c{i}" href="{f}" media-type="application/xhtml+xml"/>' for i, (f, _, _) in enumerate(pages, 1))
    spine = "".join(f'<itemref idref="c{i}"/>' for i in range(1, len(pages) + 1))
    creator = f"<dc:creator>{escape(author)}</dc:creator>" if author else ""
    opf = (
        f'<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="{NS["o"]}" version="3.0" unique-identifier="id"><metadata xmlns:dc="{NS["d"]}"><dc:identifier id="id">{escape(identifier)}</dc:identifier>'
        f"<dc:title>{escape(title)}</dc:title><dc:language>{language}</dc:language>{creator}</metadata><manifest>"
        '<item id="titlepage" href="titlepage.xhtml" media-type="application/xhtml+xml"/><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>'
        f'<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="css" href="style.css" media-type="text/css"/>{items}</manifest>'
        f'<spine toc="ncx"><itemref idref="titlepage"/><itemref idref="nav"/>{spine}</spine></package>'
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
        z.writestr("META-INF/container.xml", f'<?xml version="1.0"?><container xmlns="{NS["c"]}" version="1.0"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        z.writestr("OEBPS/content.opf", opf)
        z.writestr("OEBPS/titlepage.xhtml", page(title, f'<div id="titlepage"><h1>{escape(title)}</h1><p>{escape(author or "")}</p></div>'))
        z.writestr("OEBPS/nav.xhtml", page(title, f'<nav xmlns:epub="http://www.idpf.org/2007/ops" epub:type="toc"><ol>{links}</ol></nav>'))
        z.writestr("OEBPS/toc.ncx", f'<?xml version="1.0" encoding="utf-8"?><ncx xmlns="{NS["n"]}" version="2005-1"><head/><docTitle><text>{escape(title)}</text></docTitle><navMap>{points}</navMap></ncx>')
        z.writestr("OEBPS/style.css", STYLE)
        for f, _, text in pages:
            z.writestr(f"OEBPS/{f}", text)
    return out.getvalue()
