"""Answers sent as soon as they are complete, or at the deadline.

Requests and the answers of all kinds are one stream of events, dealt by a
hash of the request id into ``BUCKETS`` groups: a call into Python, a frame and
a state for every single id would cost far more than the merge itself.  The
group's state with a timer holds what is open, id by id: a request leaves
in the micro-batch in which its last missing answer arrives, and otherwise
when the clock passes its deadline, as partial or timeout.  The rows are
those of the batch twins (``operators/serving.py``): only answers from the
request's time to its deadline count, the earliest of a kind wins.

What is kept, and until when: an open request until its deadline; a sent one
until no repeat of it can come; an answer until no request it could answer
can come.  So the state is bounded by the traffic of one deadline window.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import constants as K
from ..operators.serving import ANSWER_FIELDS, answer_columns, valid_requests
from ..plans.shipping import ship_package

REQUEST = "request"
#: groups of request ids; fixed, as a checkpoint's states are kept by group
BUCKETS = 2048
#: plain numbers and one text, decoded by Spark
_OUT = "request_id string, at long, sent_at long, answers string"


def _events(requests: DataFrame, responses: dict[str, DataFrame]) -> DataFrame:
    """request_id, ts, kind and body (an answer's fields as JSON)."""
    out = valid_requests(requests).select("request_id", "ts", F.lit(REQUEST).alias("kind"),
                                          F.lit(None).cast("string").alias("body"))
    for kind, df in responses.items():
        fields = [(F.col(f).cast(t) if f in df.columns else F.lit(None).cast(t)).alias(f)
                  for f, t in ANSWER_FIELDS[kind].items()]
        out = out.unionByName(valid_requests(df).select(
            "request_id", "ts", F.lit(kind).alias("kind"), F.to_json(F.struct(*fields)).alias("body")))
    return out.filter(F.col("ts").isNotNull()).withColumn("at", F.unix_micros("ts"))


def _order(kind: str, at: int, body: str) -> tuple:
    """Sort key of an answer: time, then status, then the other values; a
    missing value comes first."""
    values = json.loads(body)
    names = ["status", *[f for f in ANSWER_FIELDS[kind] if f != "status"]]
    return at, [(values.get(f) is not None, values.get(f)) for f in names]


@dataclass
class Open:
    """The state of one request id.  Times are microseconds; ``due`` and the
    other bounds are on the clock of the timers, in milliseconds."""
    kinds: list[str]
    deadline: int  # seconds
    waiting: dict[int, dict] = field(default_factory=dict)  # request time -> due, answers
    sent: dict[int, int] = field(default_factory=dict)      # request time -> until
    answers: list[list] = field(default_factory=list)       # kind, time, body, until

    @staticmethod
    def load(text: str | None, kinds: list[str], deadline: int) -> Open:
        return Open.of(json.loads(text) if text else None, kinds, deadline)

    @staticmethod
    def of(form: dict | None, kinds: list[str], deadline: int) -> Open:
        out = Open(kinds, deadline)
        if form:
            out.waiting = {int(t): w for t, w in form["waiting"]}
            out.sent = {int(t): u for t, u in form["sent"]}
            out.answers = form["answers"]
        return out

    def form(self) -> dict:
        """What JSON can hold of it."""
        return {"waiting": list(self.waiting.items()), "sent": list(self.sent.items()), "answers": self.answers}

    def dump(self) -> str:
        return json.dumps(self.form())

    def _offer(self, t: int, kind: str, at: int, body: str) -> None:
        if t <= at <= t + self.deadline * 1_000_000:
            held = self.waiting[t]["answers"].get(kind)
            if held is None or _order(kind, at, body) < _order(kind, *held):
                self.waiting[t]["answers"][kind] = [at, body]

    def add(self, kind: str, at: int, body: str | None, now: int | None) -> None:
        """``now`` is the wall clock in processing time, None in event time."""
        wait = self.deadline * 1000
        if kind == REQUEST:
            if at not in self.waiting and at not in self.sent:
                self.waiting[at] = {"due": (now if now is not None else at // 1000) + wait, "answers": {}}
                for k, a, b, _ in self.answers:
                    self._offer(at, k, a, b)
        elif not any(a[:3] == [kind, at, body] for a in self.answers):
            self.answers.append([kind, at, body, now + wait if now is not None else at // 1000])
            for t in self.waiting:
                self._offer(t, kind, at, body)

    def take(self, clock: int) -> list[tuple[int, int, bool, dict[str, str]]]:
        """(request time, time sent, complete, answers) of the requests that
        are complete or due; forgets what the clock has passed."""
        out = []
        for t, w in list(self.waiting.items()):
            answers = w["answers"]
            complete = len(answers) == len(self.kinds)
            if complete or w["due"] < clock:
                at = max(a for a, _ in answers.values()) if complete else t + self.deadline * 1_000_000
                out.append((t, at, complete, {k: b for k, (_, b) in answers.items()}))
                del self.waiting[t]
                self.sent[t] = max(w["due"] - self.deadline * 1000, t // 1000) if complete else w["due"]
        self.sent = {t: u for t, u in self.sent.items() if u >= clock}
        self.answers = [a for a in self.answers if a[3] >= clock]
        return out

    def next_timer(self) -> int | None:
        times = [w["due"] for w in self.waiting.values()] + list(self.sent.values()) + [a[3] for a in self.answers]
        return min(times) if times else None


class Group:
    """The open ids of one bucket.  ``held`` keeps of each its next timer and
    its form; only ids with events or a timer that has passed are unpacked."""

    def __init__(self, kinds: list[str], deadline: int, packed: bytes | None = None):
        self.kinds, self.deadline = kinds, deadline
        self.held: dict[str, list] = json.loads(zlib.decompress(packed)) if packed else {}
        self.touched: dict[str, Open] = {}

    def of(self, request_id: str) -> Open:
        if request_id not in self.touched:
            form = self.held[request_id][1] if request_id in self.held else None
            self.touched[request_id] = Open.of(form, self.kinds, self.deadline)
        return self.touched[request_id]

    def take(self, clock: int) -> list[tuple]:
        """(request id, request time, time sent, answers) of all that leave."""
        for request_id, (timer, _) in self.held.items():
            if timer < clock:
                self.of(request_id)
        out = []
        for request_id, one in self.touched.items():
            out += [(request_id, t, at, answers) for t, at, _, answers in one.take(clock)]
            timer = one.next_timer()
            if timer is None:
                self.held.pop(request_id, None)
            else:
                self.held[request_id] = [timer, one.form()]
        self.touched = {}
        return out

    def next_timer(self) -> int | None:
        return min((timer for timer, _ in self.held.values()), default=None)

    def pack(self) -> bytes:
        return zlib.compress(json.dumps(self.held).encode(), 1)


def _processor(kinds: list[str], deadline: int, event_time: bool):
    import warnings

    import pandas as pd

    def process(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        warnings.filterwarnings("ignore", category=FutureWarning, module="pyspark")
        group = Group(kinds, deadline, bytes(state.get[0]) if state.exists else None)
        now = None if event_time else state.getCurrentProcessingTimeMs()
        if not state.hasTimedOut:
            for rows in batches:
                for rid, kind, at, body in zip(*[rows[c].tolist() for c in ("request_id", "kind", "at", "body")]):
                    group.of(rid).add(kind, at, body, now)
        clock = state.getCurrentWatermarkMs() if event_time else now
        sent = group.take(clock)
        timer = group.next_timer()
        if timer is None:
            state.remove()
        else:
            state.update((group.pack(),))
            if event_time:
                state.setTimeoutTimestamp(max(timer, clock + 1))
            else:
                state.setTimeoutDuration(max(timer - clock + 1, 1))
        if sent:
            yield pd.DataFrame({"request_id": [s[0] for s in sent], "at": [s[1] for s in sent],
                                "sent_at": [s[2] for s in sent], "answers": [json.dumps(s[3]) for s in sent]})
    return process


def _merge(requests: DataFrame, responses: dict[str, DataFrame], deadline: int, delay: str,
           event_time: bool, lag: bool) -> DataFrame:
    spark = requests.sparkSession
    ship_package(spark)
    kinds = list(responses)
    events = _events(requests, responses)
    if event_time:
        # one mark for all: a silent answer topic does not hold up the deadlines
        events = events.withWatermark("ts", delay)
    timeout = GroupStateTimeout.EventTimeTimeout if event_time else GroupStateTimeout.ProcessingTimeTimeout
    bucket = F.pmod(F.xxhash64("request_id"), F.lit(BUCKETS)).cast("int")
    sent = events.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(
        _processor(kinds, deadline, event_time), _OUT, "state binary", "append", timeout)
    bodies = F.from_json("answers", "map<string, string>")
    structs = [F.from_json(bodies[k], ", ".join(f"{f} {t}" for f, t in ANSWER_FIELDS[k].items())).alias(k)
               for k in kinds]
    first = sent.select("request_id", "at", "sent_at", *structs)
    if lag:
        return answer_columns(first, kinds, F.timestamp_micros("at").alias("ts"),
                              ((F.col("sent_at") - F.col("at")) / 1e6).alias("sent_after"))
    return answer_columns(first, kinds)


def merge_response_streams(requests: DataFrame, regression: DataFrame, classification: DataFrame,
                           deadline: int = K.RESPONSE_DEADLINE_SECONDS, delay: str = "0 seconds",
                           event_time: bool = True, lag: bool = False) -> DataFrame:
    """Merged answers.  ``event_time`` runs the deadlines on the stamps of
    the messages, held back by ``delay``; without it on the wall clock, so
    that a timeout is sent even when all topics are silent.  ``lag`` adds the
    request's time and the seconds from it to the sending."""
    return _merge(requests, {"regression": regression, "classification": classification}, deadline, delay,
                  event_time, lag)


def single_response_stream(requests: DataFrame, responses: DataFrame, kind: str = "regression",
                           deadline: int = K.RESPONSE_DEADLINE_SECONDS, delay: str = "0 seconds",
                           event_time: bool = True, lag: bool = False) -> DataFrame:
    return _merge(requests, {kind: responses}, deadline, delay, event_time, lag)
