"""The collection that every running conversation is about, kept as state while messages stream in."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from groundwork.operators.chat import Names, decision

STATE = "verlauf string"
OUT = "conv_id string, bis int, art string, namen array<string>, frage string"


def decide_streaming(messages: DataFrame, forms: list[tuple[str, str]]) -> DataFrame:
    """(conv_id, bis, art, namen, frage) after every batch that has messages of a conversation.

    ``messages`` is a stream of ``conv_id, turn, role, text``; ``forms`` the spellings of the catalogue. The
    state of a conversation is its talk; it has no time limit, as a choice holds for the whole chat. A
    message that comes twice changes nothing.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        talk = {int(k): tuple(v) for k, v in json.loads(state.get[0]).items()} if state.exists else {}
        for part in parts:
            for turn, role, text in zip(part["turn"], part["role"], part["text"]):
                talk[int(turn)] = (role or "", text or "")
        state.update((json.dumps(talk),))
        order = sorted(talk)
        kind, names, _, question = decision([talk[t] for t in order], Names(forms))
        yield pd.DataFrame({"conv_id": [key[0]], "bis": pd.array([order[-1]], "Int32"), "art": [kind], "namen": [names], "frage": [question]})

    d = messages.where("conv_id is not null and turn is not null").select(F.col("conv_id").cast("string").alias("conv_id"), "turn", "role", "text")
    return d.groupBy("conv_id").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
