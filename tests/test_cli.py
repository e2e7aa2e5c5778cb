import json
import threading
import urllib.error
import urllib.request

import pytest

from loomwright import cli
from loomwright.server import Service, serve


@pytest.fixture()
def built(spark, tmp_path, capsys):
    docs = tmp_path / "docs"
    docs.mkdir()
    for name in ("button", "table"):
        (docs / f"{name}.md").write_text(f"---\ntitle: {name}\nurl: https://x/{name}\ndomain: x\n---\n# Use\n\n" + f"The {name} is for {name} things. " * 12)
    path = f"file://{tmp_path}/index"
    assert cli.main(["index", str(docs), path], spark) == 0 and cli.main(["index", str(docs), path], spark) == 0
    assert capsys.readouterr().out.splitlines()[-2:] == ["2 chunks, 2 added, 0 deleted, 2 encoded", "2 chunks, 0 added, 0 deleted, 0 encoded"]
    return str(docs), path


def test_command_line(spark, built, capsys):
    assert cli.main(["ask", built[1], "what is a table for", "--top-k", "1", "--domain", "x"], spark) == 0
    out = capsys.readouterr().out
    assert "table things" in out and "1. table > Use" in out
    assert cli.main(["ask", built[1], " "], spark) == 1 and cli.main(["ask", built[1] + "-none", "q"], spark) == 1
    assert cli.main(["stats", built[1]], spark) == 0 and "'document_count': 2" in capsys.readouterr().out


def test_server(spark, built):
    server = serve(Service(spark, built[1], built[0]), 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"

    def call(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(at + path, None if body is None else json.dumps(body).encode())) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    assert call("/health")[1]["status"] == "healthy" and call("/stats")[1]["document_count"] == 2 and call("/no")[0] == 404
    code, got = call("/query", {"question": "button things", "top_k": 1})
    assert code == 200 and got["sources"][0]["title"] == "button" and len(got["sources"][0]["content"]) == 203
    assert call("/query", {"question": "", "top_k": 1})[0] == 422 and call("/query", {"question": "q", "top_k": 21})[0] == 422
    assert call("/refresh", {})[1] == {"status": "done", "chunks": 2, "added": 0, "deleted": 0, "encoded": 0}
    server.shutdown()
