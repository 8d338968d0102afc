"""Stored tables held in the cluster's cache, and loaded anew when another version is published."""

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from viewmart.sources.layers import layer_version, read_layer

#: How long a loaded table is used before its version is looked up again.
RELOAD_SECONDS = 300.0


class LayerCache:
    """Tables of one layer, each read once and kept until it expires or ``clear`` is called.

    Within ``seconds`` of a look at its version a table is handed out as it is, also if a new one was
    published meanwhile. Later, a table of the same version stays in the cache and one of another
    version is loaded in its place. ``clear`` drops all of them at once. A missing table is an error
    that names it, and nothing is kept of it.
    """

    def __init__(
        self, spark: SparkSession, base: str, layer: str = "gold", seconds: float = RELOAD_SECONDS, clock: Callable[[], float] = time.monotonic
    ):
        self.spark, self.base, self.layer, self.seconds, self.clock = spark, base, layer, seconds, clock
        self._held: dict[str, tuple[int, DataFrame, float]] = {}

    def get(self, table: str) -> DataFrame:
        now = self.clock()
        held = self._held.get(table)
        if held and now - held[2] < self.seconds:
            return held[1]
        version = layer_version(self.spark, self.base, self.layer, table)
        if held and version and version == held[0]:
            self._held[table] = (version, held[1], now)
            return held[1]
        # The version found is the one read, whatever is published in between.
        loaded = read_layer(self.spark, self.base, self.layer, table, version or None).cache()
        self._drop(table)
        self._held[table] = (version, loaded, now)
        return loaded

    def _drop(self, table: str) -> None:
        held = self._held.pop(table, None)
        if held:
            held[1].unpersist()

    def clear(self) -> None:
        for table in list(self._held):
            self._drop(table)
