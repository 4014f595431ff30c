"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space of every word rule here: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def worker_state(name: str, build: Callable[[], Any]) -> Any:
    """An object that a Python worker builds once and keeps between tasks.

    Functions travel to the workers by value, so a module variable would be new in each task.
    """
    kept = sys.modules.setdefault("_kept_between_tasks", types.ModuleType("_kept_between_tasks")).__dict__
    if name not in kept:
        kept[name] = build()
    return kept[name]


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    # Only a text without words leaves an empty one.
    return F.array_remove(F.split(trimmed, r"[\x20\x09-\x0D]+"), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` with the value computed once, also where the body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, or with underscores in front until no column has that name."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def dealt(files: DataFrame, name: str) -> DataFrame:
    """A list of files over as many tasks as a shuffle has.

    The list is small, so that without a number it would be put into one task.
    """
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(parts, name)


def open_store(folder: str):
    """The file system of a shared folder and the folder's path in it, for tasks that write own formats."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    if folder.startswith("/"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def put_file(folder: str, name: str, parts: Iterator[bytes], attempt: str) -> str:
    """Write ``parts`` under ``name``; a repeated task replaces the same file, readers never see half of one."""
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    part, path = f"{root}/.{name}.{attempt}-{os.getpid()}", f"{root}/{name}"
    with store.open_output_stream(part, compression=None) as out:
        for data in parts:
            out.write(data)
    store.move(part, path)
    return name


def get_file(folder: str, name: str) -> bytes:
    store, root = open_store(folder)
    with store.open_input_stream(f"{root}/{name}", compression=None) as source:
        return source.read()
