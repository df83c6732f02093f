import hashlib

import pytest

from quotewright.operators import book
from quotewright.sources.fingerprint import record_bytes, stream_sha256
from quotewright.sources.synthetic import Settings, stream, synthetic_events

#: Published fingerprints of two streams with seed 7.
GOLDEN = {
    Settings(6_000): "1e910893059341fc01c740a3ada61ba3dcf0df30a2663150d868d6e12babd0bc",
    Settings(20_000, regime_length=5_000, reset_interval=10_000): "8a845f3b206876f8f0769d9e051d7016436355c605297f4d14fda6df2cc04237",
}


@pytest.mark.parametrize("settings", GOLDEN)
def test_published_streams(settings):
    assert hashlib.sha256(b"".join(record_bytes(*r) for r in stream(settings, 7))).hexdigest() == GOLDEN[settings]


def test_in_parallel(spark):
    s = Settings(180, levels=3, regime_length=30, reset_interval=45)
    e = synthetic_events(spark, s, [7, 8, 7]).cache()
    sha = {r.symbol: r.stream_sha256 for r in stream_sha256(e, ["symbol"]).collect()}
    assert sha[0] == sha[2] == hashlib.sha256(b"".join(record_bytes(*r) for r in stream(s, 7))).hexdigest() != sha[1]
    d = book.book_deltas(book.with_epochs(e))
    assert d.where("clamped").count() == 0
    m = book.market(e)
    assert m.where("is_crossed").count() == 0 and m.where("epoch > 1 and midpoint_ticks is null and event_type not in ('RESET', 'SNAPSHOT')").count() == 0


def test_settings_and_seed():
    for bad in ({"event_count": 10}, {"start_price_ticks": 10}):
        with pytest.raises(ValueError):
            Settings(**bad)
    with pytest.raises(ValueError):
        next(stream(Settings(), -1))
