"""Places for a user's own code: named strategies, and an engine that answers prompts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import TypeVar

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

T = TypeVar("T", bound=Callable)


class Registry(dict[str, Callable]):
    """Functions by name; a name that holds another function already is an error."""

    def register(self, name: str) -> Callable[[T], T]:
        def put(f: T) -> T:
            if self.get(name, f) is not f:
                raise ValueError(f"{name} is registered already")
            self[name] = f
            return f

        return put


ADVANTAGES, LOSSES, REWARDS = Registry(), Registry(), Registry()


def generate(df: DataFrame, prompt: str, engine: Callable[[list[str]], list[str]], response: str = "response", retries: int = 5, wait: float = 0.5) -> DataFrame:
    """Adds the engine's response to each prompt, batch by batch; a batch that fails is tried again up to retries times, then fails the task.

    Null prompts are not sent and get null. The engine runs on the executors.
    """

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            asked = b[prompt].notna()
            prompts = b.loc[asked, prompt].tolist()
            for attempt in range(retries + 1):
                try:
                    found = engine(prompts) if prompts else []
                    break
                except Exception:
                    if attempt == retries:
                        raise
                    time.sleep(wait * 2**attempt)
            if len(found) != len(prompts):
                raise ValueError("the engine must answer each prompt once")
            out = pd.Series([None] * len(b), index=b.index, dtype=object)
            out[asked] = found
            yield b.assign(**{response: out})

    return df.mapInPandas(answer, StructType([*df.schema.fields, StructField(response, StringType())]))
