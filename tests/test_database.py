"""A small schema of scripts as a graph."""

import pytest

from quarrygraph.operators import rules, traverse
from quarrygraph.plans import catalog
from quarrygraph.sources import database

SCRIPTS = [
    ("a/01.sql", """create table people (id number primary key, title varchar2(50) not null);
create table invoices (id number primary key, person_id number references people(id), total number);
create table notes (id number, body varchar2(99));
create sequence invoice_seq;
create synonym folk for people;
create index inv_ix on invoices (person_id);
create or replace view open_v as select i.id, p.title from invoices i join folk p on p.id = i.person_id;"""),
    ("b/inv.pkb", """create or replace package body inv_pkg as
  procedure put(p number) is begin insert into invoices (id, total) values (invoice_seq.nextval, p); note_pkg.say('x'); end put;
  procedure put(p varchar2) is begin put(1); exception when others then null; end put;
  procedure sweep is begin delete from invoices; commit; legacy_util.clean_up(1); end sweep;
end inv_pkg;
/"""),
    ("b/note.pkb", """create or replace package body note_pkg as
  procedure say(p varchar2) is begin execute immediate 'insert into notes values (' || p || ')'; end;
end note_pkg;
/
create or replace trigger inv_trg after insert on invoices for each row begin note_pkg.say('new'); end;
/"""),
]


@pytest.fixture(scope="module")
def graph(spark):
    return database.database_graph(spark.createDataFrame(SCRIPTS, "path string, text string"))


def edges(graph, kind):
    return {(r.src, r.dst) for r in graph.of_type(kind).collect()}


def test_nodes(graph):
    n = {r["label"]: r["count"] for r in graph.nodes.groupBy("label").count().collect()}
    assert n["DbTable"] == 3 and n["DbPackage"] == 2 and n["DbProgramUnit"] == 4 and n["DbTrigger"] == 1 and n["DbColumn"] == 7
    ids = {r.id for r in graph.by_label("DbProgramUnit").collect()}
    assert ids == {"db:APP.INV_PKG.PUT", "db:APP.INV_PKG.PUT#2", "db:APP.INV_PKG.SWEEP", "db:APP.NOTE_PKG.SAY"}


def test_edges(graph):
    assert edges(graph, "REFERENCES_TABLE") == {("db:APP.INVOICES", "db:APP.PEOPLE")}
    assert edges(graph, "DEPENDS_ON") == {("db:APP.OPEN_V", "db:APP.INVOICES"), ("db:APP.OPEN_V", "db:APP.PEOPLE")}
    assert edges(graph, "FIRES_ON") == {("db:APP.INV_TRG", "db:APP.INVOICES")}
    calls = edges(graph, "CALLS")
    assert ("db:APP.INV_PKG.PUT", "db:APP.NOTE_PKG.SAY") in calls and ("db:APP.INV_TRG", "db:APP.NOTE_PKG.SAY") in calls
    assert {d for _, d in edges(graph, "UNRESOLVED")} == {"unresolved:LEGACY_UTIL.CLEAN_UP"}
    assert {d for _, d in edges(graph, "WRITES_TO")} == {"db:APP.INVOICES"}


def test_flags_and_coverage(graph):
    p = {r.id: r.props for r in graph.by_label("DbProgramUnit").collect()}
    assert p["db:APP.INV_PKG.PUT#2"]["othersNull"] == "true" and p["db:APP.INV_PKG.SWEEP"]["commits"] == "true"
    assert p["db:APP.NOTE_PKG.SAY"]["dynamicSql"] == "true" and p["db:APP.NOTE_PKG.SAY"]["concatenatesInput"] == "true"
    c = database.coverage(graph).first()
    assert c.parseQuality == 100.0 and c.unresolved == 1


def test_commit_in_trigger(spark):
    text = """create table t (a number);
create or replace trigger bad_trg after insert on t for each row begin update t set a = 1 where a = 2; commit; end;
/
create or replace trigger good_trg after insert on t for each row begin update t set a = 1 where a = 2; end;
/
"""
    g = database.database_graph(spark.createDataFrame([("a.sql", text)], "path string, text string"))
    p = {r.name: r.props for r in g.by_label("DbTrigger").collect()}
    assert set(p) == {"BAD_TRG", "GOOD_TRG"} and p["BAD_TRG"]["target"] and p["BAD_TRG"]["commits"] == "true" and p["GOOD_TRG"]["commits"] == "false"
    assert [r.target for r in rules.issues(g, catalog.database()).filter("rule = 'O-CORR-002'").collect()] == ["db:APP.BAD_TRG"]


def test_blast_radius(graph):
    up = {r.id for r in traverse.blast_radius(graph, ["db:APP.PEOPLE"], "up", 6, database.WEIGHTS, database.STRUCTURAL).collect()}
    assert {"db:APP.INVOICES", "db:APP.OPEN_V", "db:APP.INV_TRG", "db:APP.INV_PKG.PUT"} <= up
