"""Locations on any Hadoop file system, and settings by the longest registered prefix."""
from __future__ import annotations

import os
import re
import tempfile
import uuid
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import SparkSession

_SETTINGS: dict[str, dict[str, str]] = {}
#: file systems opened with registered settings, by scheme, authority and settings
_OPEN: dict[tuple, object] = {}


def register_settings(prefix: str, settings: dict[str, str]) -> None:
    """Hadoop settings for all locations under ``prefix`` (a url, or ``scheme://`` for a default).

    They hold for these locations alone: the session's own settings aren't touched.
    """
    _SETTINGS[prefix if prefix.endswith("://") else normal(prefix)] = {k: str(v) for k, v in settings.items()}


def unregister_settings(prefix: str) -> None:
    _SETTINGS.pop(prefix if prefix.endswith("://") else normal(prefix), None)


def settings_for(url: str) -> dict[str, str]:
    url = url if "://" in url else url.replace("file:", "file://", 1)
    under = lambda p: url.startswith(p) if p.endswith("://") else f"{url}/".startswith(f"{p.replace('file:', 'file://', 1)}/")
    hits = [p for p in _SETTINGS if under(p)]
    return _SETTINGS[max(hits, key=len)] if hits else {}


def normal(url: str) -> str:
    """A url with scheme; bare paths become absolute ``file:`` ones."""
    if "://" in url:
        scheme, rest = url.split("://", 1)
        return f"file:{'/' + rest.lstrip('/')}" if scheme == "file" else f"{scheme}://{rest.rstrip('/')}"
    if url.startswith("file:"):
        url = url[5:]
    return "file:" + (os.path.abspath(url) if url != "/" else "/")


def absolute(path: str, root: str) -> str:
    """``path`` itself if it has a scheme or is rooted, else below ``root``."""
    return normal(path) if re.match(r"^[a-z][a-z0-9+.-]*:", path) or path.startswith("/") else f"{root}/{path}"


def file_key(url: str) -> str:
    """One spelling for a file's url."""
    return re.sub(r"^file:/+", "file:/", url)


def scanned_key(uri: str) -> str:
    """``file_key`` of a scan's ``_metadata.file_path``, which encodes the url once more."""
    return file_key(unquote(uri))


def scratch(spark: SparkSession, name: str = "table") -> str:
    """A new folder below ``spark.checkpoint.dir``, or a temporary one where that is unset on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lakeledger-")
    return f"{normal(base)}/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Location:
    spark: SparkSession
    url: str

    @classmethod
    def of(cls, spark: SparkSession, where: "str | Location") -> "Location":
        return where if isinstance(where, Location) else cls(spark, normal(where))

    @property
    def local(self) -> str | None:
        return self.url[5:] if self.url.startswith("file:") else None

    @property
    def name(self) -> str:
        return self.url.rsplit("/", 1)[1]

    @property
    def parent(self) -> "Location":
        return Location(self.spark, self.url.rsplit("/", 1)[0])

    def child(self, *parts: str) -> "Location":
        return Location(self.spark, "/".join([self.url, *parts]))

    def _path(self, url: str | None = None):
        return self.spark._jvm.org.apache.hadoop.fs.Path(url or self.url)

    @property
    def settings(self) -> dict[str, str]:
        return settings_for(self.url)

    def _conf(self):
        conf = self.spark._jvm.org.apache.hadoop.conf.Configuration(self.spark._jsc.hadoopConfiguration())
        for k, v in self.settings.items():
            conf.set(k, v)
        return conf

    def _fs(self):
        if not self.settings:
            return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())
        uri = self._path().toUri()
        key = (self.spark.sparkContext.applicationId, uri.getScheme(), uri.getAuthority(), tuple(sorted(self.settings.items())))
        if key not in _OPEN:
            # Hadoop's own cache tells file systems apart by scheme and authority only
            _OPEN[key] = self.spark._jvm.org.apache.hadoop.fs.FileSystem.newInstance(uri, self._conf())
        return _OPEN[key]

    def exists(self) -> bool:
        return os.path.exists(self.local) if self.local else self._fs().exists(self._path())

    def is_dir(self) -> bool:
        return os.path.isdir(self.local) if self.local else self._fs().getFileStatus(self._path()).isDirectory()

    def mkdir(self, exist_ok: bool = True) -> None:
        if not exist_ok and self.exists():
            raise FileExistsError(self.url)
        os.makedirs(self.local, exist_ok=True) if self.local else self._fs().mkdirs(self._path())

    def files(self, recursive: bool = False) -> list[tuple[str, int, int]]:
        """(url, size, modified ms), sorted by url."""
        out = []
        if self.local:
            for top, dirs, names in os.walk(self.local):
                for n in names:
                    st = os.stat(p := os.path.join(top, n))
                    out.append(("file:" + p, st.st_size, int(st.st_mtime * 1000)))
                if not recursive:
                    break
        elif self.exists():
            it = self._fs().listFiles(self._path(), recursive)
            while it.hasNext():
                s = it.next()
                out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
        return sorted(out)

    def read_text(self) -> str:
        if self.local:
            with open(self.local, encoding="utf-8") as f:
                return f.read()
        return "\n".join(r[0] for r in self.spark.read.options(**self.settings).text(self.url).collect())

    def rename(self, to: "Location") -> None:
        to.parent.mkdir()
        if self.local:
            os.rename(self.local, to.local)
        elif not self._fs().rename(self._path(), self._path(to.url)):
            raise OSError(f"can't rename {self.url}")

    def remove(self) -> None:
        self._fs().delete(self._path(), True)

    def publish(self, text: str) -> None:
        """Writes the file whole or not at all, and raises FileExistsError if it is there: never overwrites."""
        self.parent.mkdir()
        temp = self.parent.child(f".{self.name}.{uuid.uuid4().hex}.tmp")
        if self.local:
            with open(temp.local, "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(temp.local, self.local)
            finally:
                os.unlink(temp.local)
            return
        out = self._fs().create(self._path(temp.url), True)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self._conf())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(temp.url), self._path(), none)
        except Exception as e:
            temp.remove()
            if "FileAlreadyExists" in str(e):
                raise FileExistsError(self.url) from e
            raise
