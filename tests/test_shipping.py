"""The archive of the package is sent once, also when several threads ask for it."""

import time
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

from ledgerlens import shipping


def test_threads_send_one_archive(monkeypatch):
    sent = []
    monkeypatch.setattr(shipping.shutil, "make_archive", lambda stem, *_: time.sleep(0.05) or f"{stem}.zip")
    context = SimpleNamespace(applicationId="test-of-threads", addPyFile=sent.append)
    session = SimpleNamespace(sparkContext=context)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(shipping.ship_code, [session] * 4))
    assert len(sent) == 1
    shipping.ship_code(session)
    assert len(sent) == 1
