"""Engines that live as long as a Python worker: made when first used, once, whatever the number of tasks; a failure is remembered too."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

_made: dict[str, tuple[Any, str | None]] = {}

BOXES = "doc_id string, page_no int, seq int, text string, conf double, problem string"


def engine(name: str, make: Callable[[], Any]) -> tuple[Any, str | None]:
    """(engine, None), or (None, why it can't be made), of this process."""
    if name not in _made:
        try:
            _made[name] = make(), None
        except Exception as e:  # noqa: BLE001  the plug-in's
            _made[name] = None, f"{type(e).__name__}: {e}"
    return _made[name]


def recognise(images: DataFrame, make: Callable[[], Callable[[bytes], list[tuple[str, float]]]], name: str = "ocr") -> DataFrame:
    """(doc_id, page_no, image) -> boxes (doc_id, page_no, seq, text, conf, problem) by an engine that ``make`` builds once a worker.

    An engine maps an image to (text, confidence) in reading order. Where there is no engine, or it fails on a page, or the image is
    null, the page gives one row with a problem and no text; the job goes on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, page, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                read, problem = engine(name, make)
                if read is not None:
                    try:
                        out += [(doc, page, i, text, float(conf), None) for i, (text, conf) in enumerate(read(image.as_py()))]
                        continue
                    except Exception as e:  # noqa: BLE001  the plug-in's
                        problem = f"{type(e).__name__}: {e}"
                out.append((doc, page, 0, None, None, problem))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], [c.split()[0] for c in BOXES.split(", ")])

    return images.selectExpr("cast(doc_id as string) doc_id", "cast(page_no as int) page_no", "image").mapInArrow(run, BOXES)
