"""Files that Python workers write to, and read from, the shared folder.

A task writes under a name of its own and reports it in a manifest row; only
files named in the manifest that Spark committed are ever read, so a lost or
repeated attempt leaves nothing behind that counts.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs
from pyspark import TaskContext


def _open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def task_file(folder: str, suffix: str) -> str:
    return f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}{suffix}"


@contextmanager
def writing(path: str):
    store, name = _open_fs(path)
    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(name, compression=None) as out:
        yield out


@contextmanager
def reading(path: str):
    store, name = _open_fs(path)
    with store.open_input_file(name) as found:
        yield found
