"""Word files as a table function: their body paragraphs as they are parsed."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_XML = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: What a run's parts say; all else in a run says nothing.
_SAYS = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}
#: Parts of a paragraph that hold runs of its own text.
_HOLDS = ("r", "hyperlink")


def _own_text(paragraph: ElementTree.Element) -> str:
    """The text of a paragraph's own runs and links; text boxes that hang on a run are not its text."""
    said = []
    for part in paragraph:
        if part.tag == WORD_XML + "hyperlink":
            said.append(_own_text(part))
        elif part.tag == WORD_XML + "r":
            for x in part:
                kind = x.tag.removeprefix(WORD_XML)
                said.append((x.text or "") if kind == "t" else _SAYS.get(kind, ""))
    return "".join(said)


def body_paragraphs(content: bytes) -> Iterator[str]:
    """Texts of the paragraphs that stand in a document's body itself, in order, each when its end is parsed. Paragraphs
    within tables, text boxes and content controls are not among them."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open("word/document.xml") as xml:
        path: list[ElementTree.Element] = []
        for event, element in ElementTree.iterparse(xml, ("start", "end")):
            if event == "start":
                path.append(element)
                continue
            path.pop()
            if len(path) == 2 and path[1].tag == WORD_XML + "body":
                if element.tag == WORD_XML + "p":
                    yield _own_text(element)
                # the rest of the body is never held together
                path[1].clear()


class WordParagraphs:
    """Table function: (pos, line) of the stripped body paragraphs that are not blank."""

    def eval(self, content: bytes) -> Iterator[tuple[int, str]]:
        pos = 0
        for text in body_paragraphs(content) if content is not None else ():
            if text.strip():
                yield pos, text.strip()
                pos += 1


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(doc, pos, line): stripped, non-blank body paragraphs of Word files, read from the XML in the archive. The function
    is also registered as word_paragraphs(content), for lateral joins in SQL."""
    paragraphs = F.udtf(WordParagraphs, returnType="pos int, line string")
    spark.udtf.register("word_paragraphs", paragraphs)
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc"), "content")
    return files.lateralJoin(paragraphs(F.col("content").outer())).select("doc", "pos", "line")
