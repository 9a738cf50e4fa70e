"""Declared schemas of the tables that operators exchange."""

from __future__ import annotations

WORDS_JSON = "array<struct<speaker:string,word:string,start:double,end:double>>"
WORDS = "dialogue_id string, pos int, speaker string, word string, start double, end double"
TOKENS = "dialogue_id string, speaker string, token_idx int, token string, token_id int, start double, end double"
MERGED = "dialogue_id string, A array<array<int>>, B array<array<int>>"
METRICS = "step long, split string, metric string, value double"
SHARDS = "rank int, param string, position int, numel long, values array<float>"
