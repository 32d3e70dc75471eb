import pytest

from termloom.plans.query import Kind, QueryError, parse


def kinds(query):
    q = parse(query)
    return q.boolean, [[("-" if t.negated else "") + f"{t.kind.value}:{t.phrase}" for t in b] for b in q.branches]


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("merkel", (False, [["keyword:merkel"]])),
        ("Military Conflict 2", (False, [["keyword:military"], ["keyword:conflict"], ["keyword:2"]])),
        ("isra*", (False, [["prefix:isra"]])),
        ("*", (False, [["prefix:"]])),
        ("'European Union'", (False, [["phrase:european union"]])),
        ("'new ye'*", (False, [["phrase_prefix:new ye"]])),
        ("'ye'*", (False, [["prefix:ye"]])),
        ("ReplyTo:12", (False, [["reply_to:12"]])),
        ("don't", (False, [["keyword:don"], ["keyword:t"]])),
        ("a AND b OR c", (True, [["keyword:a", "keyword:b"], ["keyword:c"]])),
        ("a NOT b", (True, [["keyword:a", "-keyword:b"]])),
        ("a NOT 'b c'", (True, [["keyword:a", "-phrase:b c"]])),
        ("NOT a AND b", (True, [["-keyword:a", "keyword:b"]])),
        ("a AND 'x NOT y'", (True, [["keyword:a", "phrase:x not y"]])),
        ("ReplyTo:1 AND 'p q'", (True, [["reply_to:1", "phrase:p q"]])),
    ],
)
def test_trees(query, expected):
    assert kinds(query) == expected


@pytest.mark.parametrize("query", ["", "  ", "a b AND c", "a AND b c", "a OR NOT b", "NOT a", "CANNOT x", "a AND 'b", "a*b", "a**", "ReplyTo:x", "a AND OR b", "a AND ", "''"])
def test_errors(query):
    with pytest.raises(QueryError):
        parse(query)


def test_scored_words():
    assert parse("trade trade isra* 'new ye'* ReplyTo:4").words == ["trade", "trade", "isra", "new", "ye"]
    assert parse("x").branches[0][0].kind is Kind.KEYWORD
