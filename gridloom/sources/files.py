"""Files by byte ranges, on local disks and on any store that a URI names."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from fnmatch import fnmatch

#: Bytes of the first range, which holds a raster's header as a rule, and of any later one at least.
FIRST, LEAST = 1 << 16, 1 << 12


def store_of(path: str):
    """(file system, path in it) of a path or URI; ``file:`` in any of its spellings is the local disk."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class Ranges:
    """A file as read-only bytes: a slice reads what it covers, and no more than a range around it."""

    def __init__(self, handle):
        self.handle, self.size = handle, handle.size()
        self.at, self.held = 0, b""

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        start, stop, _ = part.indices(self.size)
        if stop <= start:
            return b""
        if start < self.at or stop > self.at + len(self.held):
            self.handle.seek(start)
            self.at, self.held = start, self.handle.read(max(stop - start, FIRST if start == 0 else LEAST))
        return self.held[start - self.at : stop - self.at]


@contextmanager
def opened(path: str) -> Iterator[Ranges]:
    store, name = store_of(path)
    with store.open_input_file(name) as handle:
        yield Ranges(handle)


def listed(path: str, pattern: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files below a folder whose name matches, in order, or of the file itself. Names keep the URI's
    beginning."""
    from pyarrow import fs

    store, name = store_of(path)
    info = store.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise NotADirectoryError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    head = path[: len(path) - len(name)] if path.endswith(name) else ""
    last = pattern.rsplit("/", 1)[-1]
    return sorted((head + f.path, f.size) for f in store.get_file_info(fs.FileSelector(name, recursive=True)) if f.type == fs.FileType.File and fnmatch(f.base_name, last))


def _seen(name: str) -> bool:
    """As Spark lists folders: what begins with a dot or an underscore is hidden."""
    return not name.startswith((".", "_"))


def stretches(path: str, least: int) -> tuple[str, list[str]]:
    """(beginning of a URI, names) of parts of a folder that can be listed apart: the folders of the first level that has
    ``least`` of them or is the last, and the files above it."""
    from pyarrow import fs

    store, name = store_of(path)
    head = "file:" if isinstance(store, fs.LocalFileSystem) else path[: len(path) - len(name)] if path.endswith(name) else ""
    if store.get_file_info(name).type == fs.FileType.File:
        return head, [name]
    level, files = [name], []
    while level and len(level) < least:
        found = [f for folder in level for f in store.get_file_info(fs.FileSelector(folder)) if _seen(f.base_name)]
        files += [f.path for f in found if f.type == fs.FileType.File]
        level = [f.path for f in found if f.type == fs.FileType.Directory]
    return head, [*level, *files]


def files_in(store, name: str, pattern: str) -> list[str]:
    """Names of the files of a stretch that match, in order."""
    from pyarrow import fs

    if store.get_file_info(name).type == fs.FileType.File:
        return [name] if fnmatch(name.rsplit("/", 1)[-1], pattern) else []
    found = store.get_file_info(fs.FileSelector(name, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, pattern) and all(map(_seen, f.path[len(name) :].strip("/").split("/"))))
