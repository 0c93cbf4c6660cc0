"""Derived features of a clause: conditions from notes, operations, agreement site and normalised facts.

A cell has tense, aspect, voice, polarity, clause and modal ("none" where there is none); a frame has a type
and perhaps an object.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Notes that name an imperative subtype, in the order in which they are looked for (fixed values).
SUBTYPES = [("LET'S NOT", "lets_not"), ("LET'S", "lets"), ("emphatic-DO", "emphatic_do"), ("LET + third-person pronoun", "let_pronoun")]
#: Subjects of ordinary clauses: text, person, number.
SUBJECTS = [("I", 1, "singular"), ("we", 1, "plural"), ("you", 2, "singular"), ("she", 3, "singular"), ("they", 3, "plural")]
_WH = "array<struct<phrase:string,role:string>>"


def imperative_subtype(note: Column) -> Column:
    text, out = F.coalesce(note, F.lit("")), F.lit("ordinary")
    for mark, name in reversed(SUBTYPES):
        out = F.when(F.contains(text, F.lit(mark)), name).otherwise(out)
    return out


def wh_conditions(clause: Column, voice: Column, obj: Column) -> Column:
    """The WH conditions under which a cell is realised; one null where it has no WH."""
    one = lambda phrase, role: F.struct(F.lit(phrase).alias("phrase"), F.lit(role).alias("role"))
    asked = F.array_compact(F.array(F.when((voice == "active") & obj.isNotNull(), one("what", "object")), one("when", "adjunct")))
    return F.when(clause == "subject_wh_question", F.array(one("who", "subject"))).when(clause == "non_subject_wh_question", asked).otherwise(F.array(F.lit(None)).cast(_WH))


def subjects(clause: Column, voice: Column, obj: Column, wh: Column) -> Column:
    """The subjects with which a cell is realised under one WH condition; none for a passive without object."""
    one = lambda text, person, number: F.array(F.struct(text.alias("text"), F.lit(person).alias("person"), F.lit(number).alias("number")))
    every = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(p).alias("person"), F.lit(n).alias("number")) for t, p, n in SUBJECTS])
    none = F.array().cast("array<struct<text:string,person:int,number:string>>")
    passive = F.when(obj.isNull(), none).otherwise(one(obj, 3, "singular"))
    return F.when(wh["role"] == "subject", one(wh["phrase"], 3, "singular")).when(clause == "imperative", one(F.lit("you"), 2, "singular")).when(voice == "passive", passive).otherwise(every)


def chain_roles(aspect: Column, voice: Column, modal: Column) -> Column:
    """The roles of the verb chain in order."""
    return F.array_compact(F.array(
        F.when(modal != "none", F.lit("modal")), F.when(aspect.isin("perfect", "perfect_progressive"), F.lit("perfect")),
        F.when(aspect.isin("progressive", "perfect_progressive"), F.lit("progressive")), F.when(voice == "passive", F.lit("passive")), F.lit("main"),
    ))


def _do_support(aspect, voice, modal, polarity, clause, frame_type) -> Column:
    """A clause that needs an operator and has none of its own."""
    own = (aspect != "none") | (voice == "passive") | (modal != "none") | (frame_type == "copular")
    return (clause != "imperative") & ((polarity == "negative") | clause.isin("polar_question", "non_subject_wh_question")) & ~own


def operations(aspect: Column, voice: Column, modal: Column, polarity: Column, clause: Column, frame_type: Column, subtype: Column) -> Column:
    """Sorted distinct operations of a realisation."""
    asked, imperative = clause != "imperative", clause == "imperative"
    return F.array_sort(F.array_distinct(F.array_compact(F.array(
        F.when(voice == "passive", F.lit("be_passive")), F.when(aspect != "none", aspect), F.when(modal != "none", F.lit("central_modal")),
        F.when(imperative & (subtype != "ordinary"), subtype), F.when(imperative & (subtype == "ordinary") & (polarity == "negative"), F.lit("do_support_negation")),
        F.when(_do_support(aspect, voice, modal, polarity, clause, frame_type), F.lit("do_support")), F.when(asked & (polarity == "negative"), F.lit("negation")),
        F.when(clause.isin("polar_question", "non_subject_wh_question"), F.lit("operator_inversion")),
        F.when(clause == "subject_wh_question", F.lit("subject_wh")), F.when(clause == "non_subject_wh_question", F.lit("non_subject_wh")),
    ))))


def agreement_site(aspect: Column, voice: Column, modal: Column, polarity: Column, clause: Column, frame_type: Column) -> Column:
    """The word that agrees with the subject."""
    first = F.when(aspect.isin("perfect", "perfect_progressive"), "have").when((aspect == "progressive") | (voice == "passive"), "be").otherwise("main_verb")
    return F.when(clause == "imperative", "none").when(modal != "none", "modal").when(_do_support(aspect, voice, modal, polarity, clause, frame_type), "do").otherwise(first)


def realisation_facts(ops: Column, site: Column, roles: Column) -> Column:
    """Sorted operations, agreement site, edges of the chain, and what hosts negation and inversion."""
    has = lambda o: F.array_contains(ops, o)
    edges = F.zip_with(F.slice(roles, F.lit(1), F.size(roles) - 1), F.slice(roles, F.lit(2), F.greatest(F.size(roles) - 1, F.lit(0))), lambda a, b: F.concat(F.lit("chain_edge:"), a, F.lit(">"), b))
    named = F.array_compact(F.array(
        F.concat(F.lit("agreement_site:"), site), F.when(has("negation"), F.concat(F.lit("negation_host:"), site)), F.when(has("operator_inversion"), F.concat(F.lit("inverted_operator:"), site)),
        F.when(has("do_support") & has("operator_inversion"), F.lit("dependency:inverted_operator:do")), F.when(has("do_support") & has("negation"), F.lit("dependency:negation_host:do")),
        F.when(has("operator_inversion") & has("negation"), F.lit("dependency:inverted_negative_operator")),
    ))
    return F.array_sort(F.array_distinct(F.concat(ops, named, edges)))


def spec_errors(clause: Column, voice: Column, frame_passive: Column, obj: Column, wh: Column, subtype: Column, pronoun: Column, subject: Column, note: Column) -> Column:
    """What is wrong with a realisation's conditions for its cell, frame and source note."""
    role, wanted = wh["role"], imperative_subtype(note)
    tests = {
        "subject WH is missing": (clause == "subject_wh_question") & ~F.coalesce(role == "subject", F.lit(False)),
        "WH phrase is not the subject": (clause == "subject_wh_question") & (role == "subject") & (subject["text"] != wh["phrase"]),
        "other WH is missing": (clause == "non_subject_wh_question") & ~F.coalesce(role.isin("object", "adjunct"), F.lit(False)),
        "object WH needs an active object": (clause == "non_subject_wh_question") & (role == "object") & ((voice != "active") | obj.isNull()),
        "WH in a clause without": ~clause.isin("subject_wh_question", "non_subject_wh_question") & wh.isNotNull(),
        "imperative subtype is missing": (clause == "imperative") & subtype.isNull(),
        "imperative subtype elsewhere": (clause != "imperative") & subtype.isNotNull(),
        "pronoun and subtype differ": F.coalesce(subtype == "let_pronoun", F.lit(False)) != pronoun.isNotNull(),
        "frame has no passive": (voice == "passive") & ~F.coalesce(frame_passive, F.lit(False)),
        "passive subject is not the patient": (voice == "passive") & frame_passive & (clause != "subject_wh_question") & ~F.lower(subject["text"]).eqNullSafe(F.lower(obj)),
        "source note asks for another subtype": (wanted != "ordinary") & ~subtype.eqNullSafe(wanted),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(name)) for name, t in tests.items()]))
