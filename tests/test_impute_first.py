"""What the imputation writes."""

import datetime as dt

from wattlane import session
from wattlane.plans import pipelines as P


def test_imputation_writes_no_calendar_columns(spark, monkeypatch):
    start = dt.datetime(2016, 1, 1)
    rows = [(i, i % 3, start + dt.timedelta(hours=i), None if i % 5 == 0 else float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "reading_id long, building_id long, timestamp timestamp, meter_reading double")
    written, real = {}, session.materialize

    def told(d, name="stage"):
        written[name] = set(d.columns)
        return real(d, name)
    monkeypatch.setattr(session, "materialize", told)
    for fn in (P.preprocess_dashboard, P.preprocess_script):
        out = fn(df)
        assert written.pop("group-filled") == set(df.columns)
        assert out.columns[:4] == ["building_id", "reading_id", "timestamp", "meter_reading"] and "month_sin" in out.columns
        assert out.count() == 60 and out.where("meter_reading IS NULL").isEmpty()
