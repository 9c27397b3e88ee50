"""Reviews, decisions, queue evidence and strengths on small inputs."""

import hashlib

from siteglass.operators import decisions, review, strengths


def test_every_check_of_a_page_and_its_claims(spark):
    pages = [(1, "Fine text.", "2024-02-29"), (2, "TODO\n- [ ] x\nA vs. B, with limitations\n# Why?\nBecause it is so, and that is long enough.\n# How?", "2024-02-30"), (3, None, "")]
    claims = [(1, 1, "Fine", "u", "quote", "a quote here", "2024-01-01"), (2, 1, "absent", " ", "q", "q", None), (2, 2, "A", "u", "zz", "q", "01/02/2024"), (9, 1, "x", "u", "q", "q", None)]
    pages = spark.createDataFrame(pages, "page_id long, body string, updated_at string")
    claims = spark.createDataFrame(claims, "page_id long, claim int, text string, source_url string, quote string, source_text string, source_date string")
    found = review.checks(pages, claims)
    got = {}
    for r in found.collect():
        got.setdefault((r["page_id"], r["claim"]), []).append((r["code"], r["state"]))
    assert sorted(got[1, None]) == [("direct_answer", "review"), ("visible_date_author", "review")] and sorted(got[1, 1]) == [("claim_truth", "review"), ("literal_quote_match", "observed_in_input")]
    assert sorted(got[2, None]) == [("comparison_with_limits", "review"), ("page_date_invalid", "found"), ("placeholder", "found"), ("question_answer", "review"), ("question_without_answer", "review"), ("unchecked_task", "found"), ("visible_date_author", "review")]
    assert sorted(got[2, 1]) == [("claim_absent", "found"), ("claim_evidence_missing", "found"), ("claim_truth", "review"), ("source_date_missing", "found")]
    assert sorted(got[2, 2]) == [("claim_truth", "review"), ("quote_absent", "found"), ("source_date_invalid", "found")]
    assert sorted(got[3, None]) == [("direct_answer", "review"), ("evidence_coverage", "review"), ("page_date_missing", "found"), ("visible_date_author", "review")] and len(got) == 6
    assert sorted(map(tuple, review.summary(found).collect())) == [(1, 0, 3), (2, 8, 6), (3, 1, 3)]
    assert review.checks(pages.where("false"), claims).count() == 0


def test_identities(spark):
    identity = spark.createDataFrame([("b", "ACME  Straße", "shop", "")], "brand string, name string, category string, audience string")
    profiles = spark.createDataFrame([("b", "p", " acme strasse", "bank", "all"), ("c", "q", "x", None, "")], "brand string, profile_url string, name string, category string, audience string")
    got = {(r["profile_url"], r["field"]): r["state"] for r in review.identity_states(identity, profiles, "brand").collect()}
    assert got == {("p", "name"): "literal_match", ("p", "category"): "review", ("p", "audience"): "unknown", ("q", "name"): "unknown", ("q", "category"): "unknown", ("q", "audience"): "unknown"}


def test_what_evidence_admits(spark):
    def case(action, wants, candidates=("u1",), explicit=("u1",), owned=(("s1", "u1"),), scope=("s1",), missing=(), doubtful=(), gaps=False, conflicts=False):
        return action, candidates, missing, doubtful, gaps, wants and (wants, "said", "s1", "q"), owned, explicit, scope, conflicts

    cases = {
        "keep": case("update", "keep"), "keep_conflict": case("update", "keep", conflicts=True), "keep_missing": case("update", "keep", missing=("m",)), "keep_gap": case("update", "keep", gaps=True), "keep_scope": case("update", "keep", scope=("s2",)), "keep_lexical": case("review", "keep", explicit=()),
        "improve": case("review", "improve"), "improve_two": case("update", "improve", candidates=("u1", "u2")), "merge": case("review", "consolidate", ("u1", "u2", "u3"), ("u1", "u2"), (("s1", "u1"), ("s2", "u2"))), "merge_unread": case("review", "consolidate", ("u1", "u2"), ("u1", "u2")),
        "merge_one": case("review", "consolidate"), "new": case("create", "new", ()), "new_not": case("update", "new", ()), "review": case("create", "review"), "odd": case("create", "rename"), "none": case("create", None, None, None, None, None, None, ("d", "d")),
    }
    plan = spark.createDataFrame([(k, v[0], "planned", v[1], v[2], v[3], v[4]) for k, v in cases.items()] + [("alone", "update", "", [], [], [], False)], "intent_id string, action string, rationale string, candidates array<string>, missing_facts array<string>, doubtful_facts array<string>, open_gaps boolean")
    analysis = spark.createDataFrame([(k, *v[5:]) for k, v in cases.items()], f"intent_id string, proposed {decisions.ADMITTED}, owned array<struct<id:string,url:string>>, explicit array<string>, scope_sources array<string>, conflicts boolean")
    rows = {r["intent_id"]: r for r in decisions.decided(plan, analysis).collect()}
    want = {"keep": "keep", "keep_conflict": "improve", "keep_missing": "improve", "keep_gap": "improve", "keep_scope": "improve", "keep_lexical": "review", "improve": "improve", "improve_two": "improve", "merge": "consolidate", "merge_unread": "review", "merge_one": "review", "new": "new", "new_not": "improve", "review": "review", "odd": "new", "none": "new"}
    assert {k: r["decision"] for k, r in rows.items()} == want
    assert rows["keep"]["reason"] == "said" and rows["keep_gap"]["reason"] == "planned" and rows["keep_gap"]["quote"] is None
    # not admitted, yet the same as the plan's: its evidence is kept
    assert (rows["improve_two"]["reason"], rows["improve_two"]["source_id"], rows["improve_two"]["quote"]) == ("planned", "s1", "q")
    assert rows["keep_conflict"]["unresolved"] == [decisions.CONFLICT, decisions.ALWAYS] and rows["none"]["unresolved"] == ["Verify fact relevance: d", decisions.ALWAYS] and rows["keep_missing"]["unresolved"][0] == "m"
    assert decisions.decided(plan, analysis, structural=True).where("intent_id = 'new'").first()["unresolved"] == [decisions.MANUAL, decisions.ALWAYS]


def test_queue_evidence(spark):
    sha = hashlib.sha256(b"text").hexdigest()
    slots = [("a", 1, sha, "complete", True, ["https://x.com/1", "https://x.com/2", "http://10.0.0.1/"]), ("b", 1, "old", "complete", True, ["https://x.com/"]), ("c", 1, sha, "pending", True, ["https://x.com/"]), ("d", 1, sha, "incomplete", None, ["https://x.com/"]), ("e", 2, sha, "complete", True, []), ("f", 1, sha, "complete", True, None)]
    slots = spark.createDataFrame([(*s[:3], "p", *s[3:5], "2024-01-01T00:00:00Z", s[5]) for s in slots], "slot_id string, question_id long, text_sha256 string, provider string, status string, answer_complete boolean, observed_at string, cited_urls array<string>")
    rows, left = decisions.queue_citations(slots, spark.createDataFrame([(1, "text")], "question_id long, text string"))
    assert sorted((r["slot_id"], r["place"], r["url"]) for r in rows.collect()) == [("a", 0, "https://x.com/1"), ("a", 1, "https://x.com/2")] and len({r["row_id"] for r in rows.collect()}) == 2
    assert sorted(map(tuple, left.collect())) == [("a", "not_public"), ("b", "stale_slot"), ("e", "stale_slot")]


def test_what_was_not_looked_at_is_not_zero(spark):
    sites = spark.createDataFrame([("a", "ok", 3, 0, 4, 0), ("b", "unreachable", 3, 1, 4, 1), ("c", None, None, None, None, None), ("d", "absent", 1, 1, 1, 1)], "site string, robots_state string, pages long, sitemap_files long, mirrors_checked long, mirrors_found long")
    got = {}
    for r in decisions.surface_states(sites).collect():
        got.setdefault(r["site"], {})[r["surface"]] = r["state"]
    assert got["a"] == {"pages": "observed", "robots": "observed", "sitemap": "unmeasured", "mirrors": "not_exposed"} and set(got["b"].values()) == set(got["c"].values()) == {"unmeasured"} and set(got["d"].values()) == {"observed"}
    pages = spark.createDataFrame([(1, 200, None, "", None), (2, 404, None, "t", "c"), (3, 200, "timeout", "t", "c")], "page_id long, status int, error string, title string, canonical string")
    got = [tuple(r) for r in decisions.control_values(pages, ["title", "canonical"]).orderBy("page_id", "field").collect()]
    assert got == [(1, "canonical", False, None), (1, "title", True, ""), (2, "canonical", False, None), (2, "title", False, None), (3, "canonical", False, None), (3, "title", False, None)]


def test_each_strength_with_and_without(spark):
    facts = "site string, status int, directives array<string>, jsonld_blocks int, jsonld_invalid int, text_chars int, canonical string, naver_verified boolean, title string, description string"
    rows = [("a", 200, [], 1, 0, 300, "c", True, "T1", "D1"), ("a", 200, [], 1, 0, 900, "c", False, "T2", "D2"), ("a", 404, ["noindex"], 0, 0, 1, "", False, "T1", "D1")]
    rows += [("b", 200, ["noindex"], 1, 1, 10, "", None, "T", "D"), ("b", 200, [], 1, 0, None, None, None, "T", "D"), ("c", 500, [], 1, 0, 900, "c", True, "T", "D")]
    sites = spark.createDataFrame([("a", 1, 1, 404, 1, 200), ("b", 0, None, 200, 2, 404), ("c", 1, 1, 404, 0, 200)], "site string, sitemaps_live int, sitemap_declared int, probe_404 int, redirect_hops int, llms_status int")
    said = [("a", x, "star-allow") for x in strengths.AI_SEARCH + strengths.KOREAN_SEARCH] + [("b", "Yeti", "explicit-allow"), ("b", "Daumoa", "explicit-block"), ("b", "PerplexityBot", "explicit-allow")]
    out = strengths.strengths(spark.createDataFrame(rows, facts), sites, spark.createDataFrame(said, "site string, agent string, policy string")).orderBy("site", "place").collect()
    assert [r["code"] for r in out if r["site"] == "a"] == [code for code, _ in strengths.rules()] and {r["site"] for r in out} == {"a"}
