"""Table functions over whole episodes: one partition in, any number of rows out, with a bounded history.

    windows(rows, offsets)     rows at offsets around roots, as operators.windows.offset_windows has them
    perturbed(rows, ...)       forks of an episode: a row, another legal move, and the identity of the moves before it
"""

from __future__ import annotations

import random
from collections import deque
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

_PRIME, _BASE = (1 << 61) - 1, 911382323


def windows(rows: DataFrame, offsets: Sequence[int]) -> DataFrame:
    """episode, root_turn, offset, turn of rows (episode, turn, life, root boolean) at offsets from roots of the same life without a gap.

    An episode is read once in the order of turn. It holds the rows that an offset may look back to and the
    roots that still wait for a row ahead, both no more than the largest offset.
    """
    wanted, back, ahead = sorted(set(offsets)), max([0, *[-o for o in offsets]]), max([0, *offsets])

    class Windows:
        def __init__(self):
            self.recent, self.open, self.last = deque(maxlen=back + 1), deque(), None

        def eval(self, row):
            turn, life = row["turn"], row["life"]
            if self.last != (turn - 1, life):  # a gap or a new life: nothing before counts
                self.recent.clear()
                self.open.clear()
            self.last = (turn, life)
            while self.open and self.open[0] < turn - ahead:
                self.open.popleft()
            for root in self.open:
                if turn - root in wanted:
                    yield row["episode"], root, turn - root, turn
            self.recent.append(turn)
            if row["root"]:
                for o in wanted:
                    if o <= 0 and self.recent[0] <= turn + o:
                        yield row["episode"], turn, o, turn + o
                self.open.append(turn)

    run = udtf(Windows, returnType="episode bigint, root_turn bigint, offset bigint, turn bigint")
    return run(rows.select("episode", "turn", "life", "root").asTable().partitionBy("episode").orderBy("turn"))


def perturbed(rows: DataFrame, per_episode: int, within: int, seed: str) -> DataFrame:
    """episode, turn, move, prefix_len, prefix_id: forks of an episode to be played on from another move than was chosen.

    Of the first `within` rows with another legal move (rows: episode, turn, choice, legal), per_episode are drawn without
    replacement, by a generator of the seed and the episode; each gets one of its other moves. The prefix, all choices before, is
    named by a 61-bit polynomial, so equal beginnings of episodes have equal names; the moves themselves are one join away.
    """

    class Forks:
        def __init__(self):
            self.kept, self.seen, self.random, self.hash = [], 0, None, 0

        def eval(self, row):
            if self.random is None:
                self.episode, self.random = row["episode"], random.Random(f"{seed}:{row['episode']}")
            others = sorted(set(row["legal"] or []) - {row["choice"]})
            if others and row["turn"] < within:
                # reservoir: every row so far is kept with the same chance
                self.seen += 1
                fork = (row["turn"], others[self.random.randrange(len(others))], row["turn"], self.hash)
                if len(self.kept) < per_episode:
                    self.kept.append(fork)
                elif (place := self.random.randrange(self.seen)) < per_episode:
                    self.kept[place] = fork
            code = int.from_bytes((row["choice"] or "").encode()[:7], "big") + 1
            self.hash = (self.hash * _BASE + code) % _PRIME

        def terminate(self):
            for turn, move, length, name in sorted(self.kept):
                yield self.episode, turn, move, length, name

    run = udtf(Forks, returnType="episode bigint, turn bigint, move string, prefix_len bigint, prefix_id bigint")
    return run(rows.select("episode", "turn", "choice", F.col("legal")).asTable().partitionBy("episode").orderBy("turn"))
