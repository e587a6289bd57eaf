"""The command line, and the endpoint over a socket."""

import json
import threading
from http.server import ThreadingHTTPServer
from urllib.parse import quote
from urllib.request import urlopen

from quadrille.__main__ import handler, load, main

TTL = "@prefix e: <http://e/> . @prefix no: <http://n/> .\ne:a e:p 1 , 2 .\n"


def test_commands(spark, tmp_path, capsys):
    ttl, trig, csv = tmp_path / "a.ttl", tmp_path / "b.trig", tmp_path / "c.csv"
    ttl.write_text(TTL)
    trig.write_text("@prefix e: <http://e/> . e:g { e:a e:p 5 } e:h { e:b e:q 6 }")
    csv.write_text("id,n\n1,x\n")

    def run(*args):
        main([str(a) for a in args], spark)
        return capsys.readouterr().out.strip().splitlines()

    assert run("count", ttl, trig) == ["4"]
    assert [json.loads(x)["o"]["value"] for x in run("query", "SELECT ?o WHERE { ?s <http://e/p> ?o } ORDER BY ?o", ttl)] == ["1", "2"]
    assert run("map", "--graph", "http://g/", "--format", "nquads", "--sort", ttl)[0].endswith("<http://g/> .")
    assert run("tarql", "CONSTRUCT { ?x <http://e/n> ?n } WHERE { BIND(IRI(CONCAT('http://e/', ?id)) AS ?x) }", csv) == ['<http://e/1> <http://e/n> "x" .']
    assert run("graphs", "SELECT ?o WHERE { ?s <http://e/p> ?o }", trig) == ["http://e/g\t5"]
    assert len(run("graphs", "ASK { ?s <http://e/p> ?o }", trig, "--drop")) == 1
    assert run("prefixes", "used", ttl) == ["PREFIX e: <http://e/> # 4"] and run("prefixes", "unused", ttl) == ["PREFIX no: <http://n/>"]
    (tmp_path / "bad.ttl").write_text("<a> <b>")
    got = [json.loads(x) for x in run("analyze", ttl, csv, tmp_path / "bad.ttl")]
    assert got[0]["records"] == 2 and got[1]["columns"] == ["id", "n"] and "error" in got[2]
    run("query", "CONSTRUCT WHERE { ?s ?p ?o }", ttl, "--out", tmp_path / "out", "--format", "turtle")
    assert "http://e/a" in "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))


def test_endpoint(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(TTL)
    server = ThreadingHTTPServer(("127.0.0.1", 0), handler(load(spark, [str(tmp_path / "a.ttl")])))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    get = lambda q: urlopen(f"http://127.0.0.1:{server.server_address[1]}/?query={quote(q)}").read().decode()
    assert len(json.loads(get("SELECT ?o WHERE { ?s ?p ?o }"))["results"]["bindings"]) == 2 and json.loads(get("ASK { ?s ?p 1 }"))["boolean"] is True
    assert get("CONSTRUCT { ?s <urn:q> ?o } WHERE { ?s ?p ?o FILTER(?o > 1) }").startswith("<http://e/a> <urn:q>")
    server.shutdown()
