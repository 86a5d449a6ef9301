"""Extraction: binary files to text, with a reason where there is none."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchloom.functions.analysis import lower_ascii_text
from searchloom.functions.files import EXTRACTABLE
from searchloom.operators.maintain import PROBLEMS

from . import office, pdf

MAX_BYTES, MAX_UNPACKED = 100 * 1024 * 1024, 512 * 1024 * 1024
#: Characters of extracted text that a task holds before it hands them on.
TEXTS = 1_000_000
_OLE = bytes.fromhex("D0CF11E0A1B11AE1")


def extract(data: bytes | None, ext: str, max_bytes: int = MAX_BYTES, max_unpacked: int = MAX_UNPACKED) -> tuple[str, int, str]:
    """(text, problem, detail). An empty or unsupported file has no text and no problem."""
    ext = lower_ascii_text(ext)
    no = lambda problem, detail="": ("", PROBLEMS[problem], detail)
    if ext not in EXTRACTABLE:
        return no("None")
    if data is None:
        return no("CannotOpen")
    try:
        if ext in (".docx", ".xlsx"):
            if data[:8] == _OLE:
                return no("Protected")
            return (office.docx if ext == ".docx" else office.xlsx)(data, max_unpacked), 0, ""
        if len(data) > max_bytes:
            return no("TooLarge", str(len(data)))
        if ext == ".pdf":
            if b"%PDF" not in data[:1024]:
                return no("Damaged")
            text, images = pdf.extract(data)
            return (text, 0, "") if text.strip() else no("ImagesOnly" if images else "None")
        return data.decode("utf-8", "replace"), 0, ""
    except office.TooLarge:
        return no("TooLarge")
    except pdf.Protected:
        return no("Protected")
    except (zipfile.BadZipFile, KeyError, EOFError):
        return no("Damaged")
    except Exception as e:  # noqa: BLE001 - one file's failure is that file's problem
        return no("Failed", type(e).__name__)


def extract_files(files: DataFrame, max_bytes: int = MAX_BYTES, max_unpacked: int = MAX_UNPACKED) -> DataFrame:
    """files(root, path, name, ext, size, modified_time, content binary) -> the same with text content, problem and detail."""
    kept = ["root", "path", "name", "ext", "size", "modified_time"]
    # a file over the limit is known by its size: it never reaches a task's memory
    limited = F.lower("ext").isin(*[e for e in EXTRACTABLE if e not in (".docx", ".xlsx")])
    large = F.coalesce(limited & (F.col("size") > max_bytes), F.lit(False))
    told = files.where(large).select(*kept, F.lit("").alias("content"), F.lit(PROBLEMS["TooLarge"]).alias("problem"), F.col("size").cast("string").alias("detail"))

    return extract_rows(files.where(~large), max_bytes, max_unpacked).unionByName(told)


def extract_rows(files: DataFrame, max_bytes: int = MAX_BYTES, max_unpacked: int = MAX_UNPACKED) -> DataFrame:
    """The same for files whose content is at hand: one pass, which makes each of them once."""
    kept = ["root", "path", "name", "ext", "size", "modified_time"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, out = 0, 0, []
            for k in range(len(batch)):  # one file at a time is in memory, and TEXTS of their texts at most besides the last one
                out.append(extract(batch.column(6)[k].as_py(), batch.column(3)[k].as_py() or "", max_bytes, max_unpacked))
                held += len(out[-1][0])
                if held >= TEXTS or k + 1 == len(batch):
                    text, problem, detail = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, k + 1 - start).columns[:6], pa.array(text), pa.array(problem, pa.int32()), pa.array(detail)], names=[*kept, "content", "problem", "detail"])
                    start, held, out, text = k + 1, 0, [], None
                    pa.default_memory_pool().release_unused()

    return files.select(*kept, "content").mapInArrow(run, "root string, path string, name string, ext string, size long, modified_time long, content string, problem int, detail string")
