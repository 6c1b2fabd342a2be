"""Pipelines and their layout adapters: a dimension table of pipelines, adapters found by key or by pattern, raw answers projected anew."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIPELINE = "pipeline string, provider string, model string, product_type string"
#: From a raw answer (JSON text) to an array of page items.
ITEMS = "array<struct<page:int,cls:string,text:string,x0:double,y0:double,x1:double,y1:double>>"
Adapter = Callable[[Column], Column]


@dataclass
class Registry:
    """Adapters by key, and by pattern with a priority; pipelines by name. A name is taken once."""

    keys: dict[str, Adapter] = field(default_factory=dict)
    patterns: list[tuple[int, str, Adapter]] = field(default_factory=list)
    pipelines: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    default: Adapter | None = None

    def pipeline(self, name: str, provider: str, model: str, product_type: str = "parse") -> None:
        if name in self.pipelines:
            raise ValueError(f"{name} is registered already")
        self.pipelines[name] = (provider, model, product_type)

    def adapter(self, key: str | None = None, *, pattern: str | None = None, priority: int = 0) -> Callable[[Adapter], Adapter]:
        """Registers an adapter by provider and model (`provider/model`), by a pattern of both, or, with neither, as the default."""

        def add(f: Adapter) -> Adapter:
            if key in self.keys:
                raise ValueError(f"{key} is registered already")
            if key is not None:
                self.keys[key] = f
            if pattern is not None:
                self.patterns.append((priority, pattern, f))
            if key is None and pattern is None:
                self.default = f
            return f

        return add

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n, *v) for n, v in sorted(self.pipelines.items())], PIPELINE)

    def resolve(self, name: str) -> Adapter:
        """The adapter of a pipeline: by key, else by the fitting pattern of the highest priority, else the default."""
        provider, model, _ = self.pipelines[name]
        full = f"{provider}/{model}"
        if full in self.keys:
            return self.keys[full]
        fit = [x for x in self.patterns if re.search(x[1], full)]
        found = max(fit, key=lambda x: x[0])[2] if fit else self.default
        if found is None:
            raise LookupError(f"no adapter for {full}")
        return found

    def renormalise(self, predictions: DataFrame) -> DataFrame:
        """predictions (pipeline, test_id, raw) with items: each pipeline's raw answers through its adapter, without asking anyone again.

        The pipelines are those that are registered, so the expression has a branch for each; rows of others end the query.
        """
        names = sorted(self.pipelines)
        unknown = F.raise_error(F.concat(F.lit("unknown pipeline "), F.col("pipeline"))).cast(ITEMS)
        made = reduce(lambda rest, n: F.when(F.col("pipeline") == n, self.resolve(n)(F.col("raw")).cast(ITEMS)).otherwise(rest), names, unknown)
        return predictions.withColumn("items", made)


def plain_items(raw: Column) -> Column:
    """Answers that are a list of items already."""
    return F.from_json(raw, ITEMS)


def nested_items(raw: Column) -> Column:
    """Answers by page with boxes as x, y, width and height in pixels of the page: shares of the page come out."""
    shape = "pages array<struct<number:int,width:double,height:double,blocks:array<struct<type:string,text:string,x:double,y:double,w:double,h:double>>>>"
    pages = F.from_json(raw, shape)["pages"]
    one = lambda p: F.transform(
        p["blocks"],
        lambda b: F.struct(p["number"].alias("page"), b["type"].alias("cls"), b["text"].alias("text"), (b["x"] / p["width"]).alias("x0"), (b["y"] / p["height"]).alias("y0"), ((b["x"] + b["w"]) / p["width"]).alias("x1"), ((b["y"] + b["h"]) / p["height"]).alias("y1")),
    )
    return F.flatten(F.transform(pages, one))
