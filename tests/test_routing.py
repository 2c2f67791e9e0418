"""What files are, judged by their heads, and their records by the reader that fits."""

import pytest

from threatframe.sources import routing

FILES = {
    "a space.log": "Mar  1 10:00:00 h1 sshd[7]: Failed password for bob from 10.0.0.1 port 22 ssh2\n" * 3 + "???\n",
    "b.csv": 'time,src_ip,user,note\n2024-01-01 10:00:00,10.0.0.2,ann,"x"\n2024-01-01 10:00:01,,cy,\n',
    "c.csv": "host,source_ip,status\nh9,10.0.0.3,deny\nh8,10.0.0.4,allow\n",  # another layout
    "d.json": '[\n{"eventName": "ConsoleLogin", "eventSource": "signin", "sourceIPAddress": "10.0.0.5", "userIdentity": {"arn": "dee"}},\n{"src_ip": "10.0.0.6"}\n]',
    "e.json": '{\n "src_ip": "10.0.0.7",\n "username": "eve"\n}\n',
    "f.jsonl": '{"src_ip": "10.0.0.8", "username": "fay"}\n{"src_ip": "10.0.0.9"}\n',
    "g.xml": '<?xml version="1.0"?>\n<log><row user="gus" level="1"><src_ip>10.0.0.10</src_ip></row><row user="gil" level="2"><src_ip>10.0.0.11</src_ip></row></log>',
    "h.xml": '<Event><System><EventID>4625</EventID><Computer>h2</Computer></System><EventData><Data Name="TargetUserName">hal</Data><Data Name="IpAddress">10.0.0.12</Data></EventData></Event>\n',
    "i.txt": "Log Name: Security\nEvent ID: 4625\nComputer: h3\nAccount Name: ida\nSource Network Address: 10.0.0.13\n\nLog Name: Security\nEvent ID: 4624\nComputer: h3\nAccount Name: ivo\nSource Network Address: 10.0.0.14\n",
    "j.own": "#own v1\nuser=jo;ip=10.0.0.15\nuser=joy;ip=10.0.0.16\n",
    "k.txt": "nothing that any format knows\nnor this\n",
    "l.txt": "\n \n",
}
KINDS = {"a space.log": "syslog", "b.csv": "csv", "c.csv": "csv", "d.json": "json_document", "e.json": "json_document", "f.jsonl": "json", "g.xml": "xml", "h.xml": "windows_xml", "i.txt": "windows_text", "j.own": "own", "k.txt": "generic"}


@pytest.fixture
def folder(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    routing.file_handler("own", lambda first: first.startswith("#own"))(own)
    yield str(tmp_path)
    routing.unregister_file_handler("own")


def own(stream):
    for line in stream.read().decode().splitlines()[1:]:
        yield {**dict(p.split("=") for p in line.split(";")), "nothing": None}


def name(path):
    return path.rpartition("/")[2].replace("%20", " ")


def test_every_file_is_recognized(spark, folder):
    got = {name(r.file): r for r in routing.sniff(spark, folder).collect()}
    assert {k: r.format for k, r in got.items()} == KINDS  # the blank file is none
    assert got["a space.log"].subtype == "sshd" and got["a space.log"].confidence == 0.75 and got["a space.log"].noise == 0.25
    assert got["k.txt"].noise == 1.0 and got["k.txt"].confidence == 0.0 and got["b.csv"].confidence == 1.0


def test_all_records_come_from_one_call(spark, folder):
    rows = [(name(r.file), r.format, r.src_ip, r.username, r.hostname) for r in routing.parse_folder(spark, folder).collect()]
    by = {k: sorted((r[2:] for r in rows if r[0] == k), key=str) for k in FILES}
    assert by["a space.log"] == [("10.0.0.1", "bob", "h1")] * 3 + [(None, None, None)]
    assert by["b.csv"] == [("10.0.0.2", "ann", None), (None, "cy", None)]
    assert by["c.csv"] == [("10.0.0.3", None, "h9"), ("10.0.0.4", None, "h8")]
    assert by["d.json"] == [("10.0.0.5", "dee", None), ("10.0.0.6", None, None)] and by["e.json"] == [("10.0.0.7", "eve", None)]
    assert by["f.jsonl"] == [("10.0.0.8", "fay", None), ("10.0.0.9", None, None)]
    assert by["g.xml"] == [("10.0.0.10", "gus", None), ("10.0.0.11", "gil", None)]
    assert by["h.xml"] == [("10.0.0.12", "hal", "h2")] and by["i.txt"] == [("10.0.0.13", "ida", "h3"), ("10.0.0.14", "ivo", "h3")]
    assert by["j.own"] == [("10.0.0.15", "jo", None), ("10.0.0.16", "joy", None)]
    assert len(by["k.txt"]) == 2 and {r[1] for r in rows if r[0] == "k.txt"} == {"generic"}
