"""A store of layers with atomic refreshes.

    store/data/<id>/<layer>/   Parquet, written once, never changed
    store/manifests/<number>   one line of JSON and an end mark

A refresh writes its layers below a new id and then creates the next manifest.
Creation is exclusive (a file that exists is never opened for writing), so of
two writers of one number one fails and takes the next.  A manifest counts once
its end mark is there.  Readers take the highest that is whole, so they see all
layers of one refresh or those of the one before, and never wait.  What a
writer leaves that dies on its way is read by nobody; `recover` removes it.

Exclusive creation holds on HDFS and on local and NFS file systems; a store of
objects must offer conditional puts through its Hadoop connector.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

END = "\nend\n"


class NoManifest(LookupError):
    """Nothing was published, or not that layer."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, below: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}" if below else self.path)

    def _names(self, below: str) -> list[str]:
        if not self._files.exists(self._path(below)):
            return []
        return sorted(s.getPath().getName() for s in self._files.listStatus(self._path(below)))

    def numbers(self) -> list[int]:
        """Numbers of all manifests, whole or not."""
        return [int(n) for n in self._names("manifests") if n.isdigit()]

    def read(self, number: int) -> dict | None:
        """A manifest, or None if it isn't whole."""
        stream = self._files.open(self._path(f"manifests/{number:012d}"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text[: -len(END)]) if text.endswith(END) else None

    def current(self) -> dict:
        """The highest whole manifest."""
        for number in reversed(self.numbers()):
            if (found := self.read(number)) is not None:
                return found
        raise NoManifest(self.path)

    def layer(self, name: str, manifest: dict | None = None) -> DataFrame:
        """A layer of the current refresh, or of the manifest given: readers of
        several layers take one manifest for all."""
        manifest = manifest or self.current()
        if name not in manifest["layers"]:
            raise NoManifest(f"{name} in {self.path}")
        return self.spark.read.parquet(f"{self.path}/{manifest['layers'][name]}")

    def refresh(self, layers: dict[str, DataFrame], label: str, keep: tuple[str, ...] = ()) -> dict:
        """Writes all layers and publishes them; layers named in `keep` are
        taken over from the current manifest as they are."""
        own = f"data/{uuid.uuid4().hex}"
        for name, df in layers.items():
            self.write(df, f"{own}/{name}")
        kept = {name: self.current()["layers"][name] for name in keep}
        return self.publish(label, kept | {name: f"{own}/{name}" for name in layers})

    def write(self, df: DataFrame, below: str) -> None:
        df.write.parquet(f"{self.path}/{below}")

    def publish(self, label: str, layers: dict[str, str]) -> dict:
        while True:
            number = max(self.numbers(), default=0) + 1
            stream = self.create(number)
            if stream is None:
                continue  # another writer has it
            made = {"number": number, "label": label, "layers": layers}
            self.fill(stream, json.dumps(made) + END)
            return made

    def create(self, number: int):
        """A stream to a manifest that did not exist, or None if it does."""
        try:
            return self._files.create(self._path(f"manifests/{number:012d}"), False)
        except Py4JJavaError as error:
            if self._files.exists(self._path(f"manifests/{number:012d}")):
                return None
            raise error

    def fill(self, stream, text: str) -> None:
        stream.write(bytearray(text.encode()))
        stream.close()

    def recover(self, keep: int = 2) -> list[str]:
        """Removes what no one reads: manifests that aren't whole, all but the
        last `keep` whole ones, and data that no manifest left names.  To be run
        while nobody refreshes; readers of the manifests kept are not disturbed."""
        whole, gone = [], []
        for number in self.numbers():
            found = self.read(number)
            if found is None:
                gone.append(f"manifests/{number:012d}")
            else:
                whole.append(found)
        # a torn manifest above the last whole one may go: numbers only need to grow
        gone += [f"manifests/{m['number']:012d}" for m in whole[: -keep or None]]
        used = {path.split("/")[1] for m in whole[-keep:] for path in m["layers"].values()}
        gone += [f"data/{name}" for name in self._names("data") if name not in used]
        for below in gone:
            self._files.delete(self._path(below), True)
        return gone
