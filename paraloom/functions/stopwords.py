"""Stop words for topic terms.  Fixed values."""

from __future__ import annotations

PUBLICATION = ("prepared publication suggested citation isbn report washington dc agreement review official views positions contents "
               "executive summary background overview methodology appendix annex").split()
STRUCTURE = "page section chapter paragraph figure table reference bibliography footnote note volume https www".split()
TIME = ("january february march april may june july august september october november december jan feb mar apr jun jul aug sep oct nov dec "
        "month monthly quarter quarterly annual annually year years fiscal fy 2016 2017 2018 2019 2020 2021 2022 2023 fy17 fy18").split()
UNWANTED = ["pennsylvania ave", *"de la les en des et le".split(), "de la", *("du para dan pa za ke ali tes primer wa ts ee tr ea ti te ie io ro sb fn aa uo ye").split(),
            "na na na", "na", "na na", "tbd", "90 90", "600", "200", "85", "90"]
ADMIN = "total number percent frequency details questionnaire respondents procedure guidelines".split()
ORGANISATION = "outreach reference budget procurement cooperative agreement implemented".split()
ENGLISH = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them "
    "their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an "
    "the and but if or because as until while of at by for with about against between into through during before after above below to from up down "
    "in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only "
    "own same so than too very s t can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan "
    "shouldn wasn weren won wouldn").split()


def enhanced_stopwords() -> list[str]:
    """All groups in one list without repeats."""
    return list(dict.fromkeys([*ENGLISH, *PUBLICATION, *STRUCTURE, *TIME, *UNWANTED, *ADMIN, *ORGANISATION]))
