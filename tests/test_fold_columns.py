from shotspark import fixtures as fx
from shotspark.operators import fusion


def test_fold_keeps_each_column_once(spark, sf):
    dets = fx.detections(spark, sf)
    box = fusion._fold(dets, 0.55, fusion.GROUP).schema["boxes"].dataType.elementType
    # conf is there as neg_conf, and the rank is no struct beside its own columns.
    assert sorted(box.names) == sorted({*dets.columns, "neg_conf"} - {*fusion.GROUP, "conf"})
