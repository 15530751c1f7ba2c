import random
import re

from tallyframe.llm import toxicity
from tallyframe.llm.toxicity import Grammar


def test_readings_of_clauses():
    grammar = Grammar()
    assert grammar.clauses("You are an idiot. The sky is blue.") == [[("aimed", toxicity.LISTED)]]
    assert grammar.clauses("She is not an idiot") == [[("negated", toxicity.LISTED)]]
    assert grammar.clauses("The boss said the plan was stupid; fine") == [[("reported", toxicity.LISTED)]]
    assert grammar.clauses("what an idiotic thing, pre-idiot") == [[("plain", toxicity.LISTED)]]
    assert grammar.clauses("Idiot, you are. Idiot") == [[("aimed", toxicity.LISTED)], [("plain", toxicity.LISTED)]]
    assert grammar.clauses("we will kill it. We will kill you; you we kill") == [[("vague", toxicity.LISTED)], [("threat", toxicity.LISTED)], [("threat", toxicity.LISTED)]]
    assert grammar.clauses("we will not hurt you, he said he would hurt you") == [[("negated", toxicity.LISTED), ("reported", toxicity.LISTED)]]
    assert grammar.clauses("nothing here. xidiot") == []
    assert grammar.clauses("stupid.\nstupid stupid") == [[("plain", 4.0)], [("plain", 4.0), ("plain", 4.0)]]


def test_learns_word_starts_from_labels():
    rnd = random.Random(7)
    syllables = ["ka", "lo", "mi", "ter", "bun", "sel", "dor", "fi"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randrange(2, 5)))
    rows = []
    for k in range(600):
        words = [word() for _ in range(60)]
        if k % 6 == 0:
            for _ in range(3):
                words.insert(rnd.randrange(60), "zurp" + word())
        rows.append((int(k % 6 == 0), " ".join(words)))
    grammar = toxicity.fit(rows[:450])
    assert any(s.startswith("zur") for s in grammar.starts)
    found = grammar.scores([t for _, t in rows[450:]]) >= 0.3
    assert [int(f) for f in found] == [y for y, _ in rows[450:]]


def test_held_out_rows_of_the_table(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    grammar = toxicity.train(docs, labels)
    rows = toxicity.score(docs, grammar).where("held_out").join(labels.where("toxic is not null"), "doc_id").collect()
    toxic = [r for r in rows if r.toxic == 1]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 0.015 * (len(rows) - len(toxic))
    # what was learned of one word says nothing of others that begin alike
    said = lambda *texts: grammar.scores(list(texts)).tolist()
    assert max(said("we distribute traffic data", "The committee will discuss the distribution of traditional trade.", "kill the process", "")) < 0.3
    aimed, denied, told, threat = said("you are an idiot", "you are not an idiot", "he said you are an idiot", "I will kill you")
    assert min(aimed, threat) >= 0.3 and max(denied, told) < 0.3 and said("idiot, you are") == [aimed] and said("an idiot")[0] < aimed


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (None, "idiot", 3.0), (3, "idiot " * 20000, 4.0), (3, "ok", 5.0), (3, "ok", 5.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    grammar = toxicity.train(docs, labels)
    rows = toxicity.score(docs, grammar).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert toxicity.score(docs.limit(0), grammar).count() == 0
    left = toxicity.keep_clean(docs, grammar)
    assert left.columns == docs.columns and sorted(r.score for r in left.collect()) == [1.0, 2.0, 5.0, 5.0]


def test_composed_table_against_its_parts():
    """The product against five plain state machines on random word kinds."""
    rnd = random.Random(11)
    for _ in range(300):
        state, left, aimed, told = 0, 0, False, False
        for _ in range(rnd.randrange(1, 40)):
            kinds = rnd.choice([0, 0, 0, *range(toxicity.KINDS)])
            aimed, told = aimed or bool(kinds & toxicity.TARGET), told or bool(kinds & toxicity.REPORT)
            insult, threat = bool(kinds & toxicity.INSULT), bool(kinds & toxicity.THREAT)
            want = None if not (insult or threat) else ("negated",) * 2 if left else ("reported",) * 2 if told else ("vague", "threat") if not insult else ("plain", "aimed")
            assert toxicity.MATCH[state][kinds] == want
            left = toxicity.NEGATION_SPAN if kinds & toxicity.NEGATION else max(0, left - 1)
            state = toxicity.NEXT[state][kinds]
            assert toxicity.ADDRESSED[state] == aimed


def test_a_start_needs_several_words():
    rows = [(1, f"fine words here zurpalon {k} {k + 1}") for k in range(60)] + [(0, f"fine words here surely {k} {k + 1}") for k in range(300)]
    one = toxicity.learn(rows)
    assert "zurpalon" in one.words and not one.starts
    rows = [(1, f"fine words here zurp{'abcdefgh'[k % 8]}on zurp{'hgfedcba'[k % 7]}on {k} {k + 1}") for k in range(60)] + rows[60:]
    assert "zurp" in toxicity.learn(rows).starts


def test_grammar_against_a_plain_reading_of_every_clause():
    rnd = random.Random(12)
    grammar = Grammar(starts={"zur": 3.0, "idio": 5.0, "kill": 2.5})
    words = [*toxicity.INSULTS, *toxicity.THREATS, *toxicity.TARGETS, *toxicity.NEGATIONS, *toxicity.REPORTS, "zurp", "azur", "zu", "idiotic", "killer", "sky", "blue", "", "9idiot", "x_trash"]

    def plain(text):
        found = []
        for clause in re.split(r"[.!?;:\n|]+", text.lower()):
            left, aimed, told, matches = 0, False, False, []
            for word in re.findall(r"[^\W\d_]+", clause):
                if word in toxicity.NEGATIONS:
                    left = toxicity.NEGATION_SPAN
                    continue
                aimed, told = aimed or word in toxicity.TARGETS, told or word in toxicity.REPORTS
                insult = max([grammar.words.get(word, 0.0), *(w for p, w in grammar.starts.items() if word.startswith(p))])
                weight = insult or grammar.threats.get(word, 0.0)
                if weight:
                    matches.append(("negated" if left else "reported" if told else "threat" if not insult else "insult", weight))
                left = max(0, left - 1)
            if matches:
                last = {"threat": "threat" if aimed else "vague", "insult": "aimed" if aimed else "plain"}
                found.append([(last.get(r, r), w) for r, w in matches])
        return found

    for _ in range(500):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", ", ", ". ", "! ", "\n", "...", "|"]) for _ in range(rnd.randrange(40)))
        assert grammar.clauses(text) == plain(text)


def test_long_texts_take_linear_time():
    grammar = Grammar()
    assert len(grammar.clauses("you idiot. " * 900_000)) == 900_000
    assert [len(c) for c in grammar.clauses("you idiot " * 100_000)] == [100_000]
