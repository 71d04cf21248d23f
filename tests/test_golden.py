"""The pipeline on ten patients gives the known table."""

import pytest

from helixmill.plans import pipeline
from helixmill.sources import exports, readers

# Ten patients with three gaps, and the table that imputation by the median, log2(x + 1) and z-scores make of them.
EXPRESSION = """patient_id,TP53,BRCA1,EGFR,KRAS,PTEN
P001,6279.660701109152,628.8537819982059,1746.9885725391325,91.71030132705573,2470.8394693024043
P002,2422.6167781632785,627.1114623431033,321.8944508809113,653.1602778367146,1324.1223072519517
P003,,1466.0906652757533,431.61250419591283,146.81924733316598,965.6359399045614
P004,29276.627622422006,110.39487453045041,97.05247521141041,63.67749839938764,787.4390216306819
P005,2098.0632534689735,138.39315736878822,234.06931173058362,286.58521591640533,215.64333382283598
P006,2098.1149223981756,,450.75438474894423,55.88662472270969,496.791971849674
P007,31850.846019241842,325.252777063382,127.61353291029137,175.40382307159143,660.6983303526855
P008,9425.292946871536,1598.9409760517217,587.3953005727673,30.94662359382786,3508.116100404542
P009,1474.0786375629527,368.8430111127292,221.2650513071716,51.28771043883719,1600.3539756259795
P010,6726.700704624201,201.38843556402523,301.3602069810315,173.7276752978519,157.69390266819346
"""
CLINICAL = """patient_id,age,sex,stage,survival_months,treatment_response
P001,58.0,F,III,33,Responder
P002,,M,IV,1,Responder
P003,46.0,F,II,6,Non-responder
P004,62.0,M,I,1,Responder
P005,67.0,M,III,60,Non-responder
P006,66.0,F,III,22,Responder
P007,44.0,F,III,42,Responder
P008,51.0,M,III,142,Responder
P009,58.0,M,II,17,Non-responder
P010,66.0,F,III,31,Non-responder
"""
RESULT = """P001,0.08846487343055078,0.48074831288916803,2.075924155244725,-0.25811941910004405,1.1012425719753025,58.0
P002,-0.7934491884925131,0.47766817412127205,-0.005960862471041048,1.8945246195450003,0.47073979139183497,58.0
P003,0.08846487343055078,1.4209467700709075,0.35462189418749857,0.25585023812129853,0.15173730474000746,46.0
P004,1.5141661917970173,-1.4455812576439362,-1.4751090573123629,-0.6548158836709774,-0.05433209070736465,62.0
P005,-0.9266047249746082,-1.1962656106594982,-0.3972723094280974,0.989084775874429,-1.3607318856586255,67.0
P006,-0.9265819273187055,-0.11125790596093292,0.40799271883011556,-0.7962266025701116,-0.5194013650025353,66.0
P007,1.5922162527141501,-0.25070184855678623,-1.1406688047502418,0.4506205665706803,-0.23155763767788418,44.0
P008,0.4645163456416141,1.517335656908606,0.7337438910394214,-1.4319190354946012,1.4556036224063744,51.0
P009,-1.253339533413632,-0.11125790596093292,-0.46631506701803727,-0.8891013759553446,0.662224091648394,58.0
P010,0.15214683718558358,-0.7816343852078638,-0.0869565583219735,0.4401021166796748,-1.6755244031155025,66.0
"""


def test_ten_patients(spark, tmp_path):
    (tmp_path / "omic.csv").write_text(EXPRESSION)
    (tmp_path / "clinical.csv").write_text(CLINICAL)
    omic, clinical = readers.read_csv(spark, str(tmp_path / "omic.csv")), readers.read_csv(spark, str(tmp_path / "clinical.csv"))
    out = pipeline.run_checked(omic, clinical, "patient_id")
    assert out["status"] == "success" and (out["n_samples"], out["completeness_percent"]) == (10, 100.0)
    assert out["data"].columns == ["patient_id", "TP53", "BRCA1", "EGFR", "KRAS", "PTEN", "age", "sex", "stage", "survival_months", "treatment_response"]
    want = {line.split(",")[0]: [float(x) for x in line.split(",")[1:]] for line in RESULT.splitlines()}
    rest = {line.split(",")[0]: line.split(",")[2:] for line in CLINICAL.splitlines()[1:]}
    exports.write_parquet(out["data"], str(tmp_path / "out"))
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        assert list(r)[1:7] == pytest.approx(want[r["patient_id"]], abs=1e-9) and [str(x) for x in list(r)[7:]] == rest[r["patient_id"]]
