"""The consumer takes and gives rows: no frame is made for a key."""

from pyspark.sql import Row

from verdictlake.streaming import consumer as C


class Value:
    def __init__(self):
        self.held = None

    def get(self):
        return self.held

    def update(self, new):
        self.held = new


class Items(list):
    def get(self):
        return iter(self)

    def appendList(self, new):  # noqa: N802  Spark's name
        self.extend(new)


class Handle:
    def getValueState(self, name, schema):  # noqa: N802
        return Value()

    def getListState(self, name, schema):  # noqa: N802
        return Items()


def test_rows_in_and_rows_out():
    consumer = C.Consumer()
    consumer.init(Handle())
    body = "".join(f'data: {x}\n\n' for x in ('{"type":"start"}', '{"type":"verdict","scenario_id":"7","status":"pass"}', '{"type":"token","content":"so"}', '{"type":"complete"}'))
    rows = [Row(key="k", n=n, chunk=body[n * 30 : n * 30 + 30]) for n in range(len(body) // 30 + 1)]
    assert [r.text for r in consumer.handleInputRows(("k",), iter(rows[:2]), None)] == [None]
    found = list(consumer.handleInputRows(("k",), iter(rows), None))
    assert [(type(r), r.key, r.run, r.streaming, r.verdicts, r.tokens, r.text, r.total) for r in found] == [(Row, "k", 1, False, ["7:pass"], 1, "so", None)]
    assert list(found[0].asDict()) == [x.split()[0] for x in C.STATE.split(", ")]
    assert not list(consumer.handleInputRows(("k",), iter(rows), None))
