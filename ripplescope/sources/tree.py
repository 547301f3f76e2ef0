"""Source trees as a partitioned table: folders that don't count are never listed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SHAPE = "file string, modified_ms long, size long, text string"
#: Folders from which on a tree is listed in tasks.
PARTS = 64


@dataclass
class Folders(InputPartition):
    """Folders of one task: those whose own files are wanted, and those that are walked."""

    own: list[str]
    deep: list[str]


class Tree:
    """A walk below a root on any file system that workers can reach."""

    def __init__(self, options: dict[str, str]):
        from pyarrow import fs

        path = options["path"].rstrip("/") or "/"
        scheme, colon, rest = path.partition(":")
        local = path if not colon else "/" + rest.lstrip("/") if scheme == "file" else None
        self.fs, self.root = (fs.LocalFileSystem(), local) if local else fs.FileSystem.from_uri(path)
        self.selector, self.folder, self.file = fs.FileSelector, fs.FileType.Directory, fs.FileType.File
        self.skipped = set(options.get("skipped", "").split("/"))
        self.endings = tuple(e for e in options.get("endings", "").split("/") if e)
        self.any_case, self.nested, self.content = (options.get(k) == "true" for k in ("any_case", "nested", "content"))

    def wanted(self, name: str) -> bool:
        return not self.endings or (name.lower() if self.any_case else name).endswith(self.endings)

    def listed(self, folder: str) -> tuple[list[str], list]:
        """Folders to go on with and wanted files of one folder; none if it is another repository or has vanished."""
        found = self.fs.get_file_info(self.selector(folder, allow_not_found=True))
        if not self.nested and folder != self.root and any(x.base_name == ".git" for x in found):
            return [], []
        on = [x.path for x in found if x.type == self.folder and x.base_name.lower() not in self.skipped]
        return on, [x for x in found if x.type == self.file and self.wanted(x.base_name)]

    def row(self, info) -> tuple | None:
        text = None
        if self.content:
            try:
                with self.fs.open_input_stream(info.path) as stream:
                    text = stream.read().decode("utf-8", "replace")
            except OSError:  # it vanished
                return None
        return info.path[len(self.root.rstrip("/")) + 1 :], round(info.mtime_ns / 1e6), info.size, text

    def rows(self, infos: list) -> Iterator[tuple]:
        return (r for r in map(self.row, infos) if r is not None)

    def walk(self, folder: str) -> Iterator[tuple]:
        left = [folder]
        while left:
            on, files = self.listed(left.pop())
            left.extend(on)
            yield from self.rows(files)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Folders]:
        """Goes down from the root, level by level, until there are enough folders to deal out."""
        tree, parts = Tree(self.options), int(self.options.get("parts", PARTS))
        own, deep = [], [tree.root]
        while deep and len(deep) < parts:
            own, deep = own + deep, [f for folder in deep for f in tree.listed(folder)[0]]
        return [Folders(own[i::parts], deep[i::parts]) for i in range(min(parts, max(len(own), len(deep))))]

    def read(self, partition: Folders) -> Iterator[tuple]:
        tree = Tree(self.options)
        for folder in partition.own:
            yield from tree.rows(tree.listed(folder)[1])
        for folder in partition.deep:
            yield from tree.walk(folder)


class TreeSource(DataSource):
    """``(file, modified_ms, size, text)`` below the option ``path``.

    Options: ``endings`` of file names and names of ``skipped`` folders (in lower
    case), each joined by slashes; ``any_case`` of the endings; ``nested``: whether
    folders with a ``.git`` of their own, a file or a folder, are walked; ``content``:
    whether texts are read. Hidden and empty files count.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SHAPE

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))
