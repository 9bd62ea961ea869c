"""Named points of a face as text, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The points, in the order in which they are written.
POINTS = """
contour_chin contour_left1 contour_left2 contour_left3 contour_left4 contour_left5 contour_left6 contour_left7 contour_left8 contour_left9
contour_right1 contour_right2 contour_right3 contour_right4 contour_right5 contour_right6 contour_right7 contour_right8 contour_right9
left_eye_bottom left_eye_center left_eye_left_corner left_eye_lower_left_quarter left_eye_lower_right_quarter left_eye_pupil left_eye_right_corner left_eye_top
left_eye_upper_left_quarter left_eye_upper_right_quarter left_eyebrow_left_corner left_eyebrow_lower_left_quarter left_eyebrow_lower_middle
left_eyebrow_lower_right_quarter left_eyebrow_right_corner left_eyebrow_upper_left_quarter left_eyebrow_upper_middle left_eyebrow_upper_right_quarter
mouth_left_corner mouth_lower_lip_bottom mouth_lower_lip_left_contour1 mouth_lower_lip_left_contour2 mouth_lower_lip_left_contour3 mouth_lower_lip_right_contour1
mouth_lower_lip_right_contour2 mouth_lower_lip_right_contour3 mouth_lower_lip_top mouth_right_corner mouth_upper_lip_bottom mouth_upper_lip_left_contour1
mouth_upper_lip_left_contour2 mouth_upper_lip_left_contour3 mouth_upper_lip_right_contour1 mouth_upper_lip_right_contour2 mouth_upper_lip_right_contour3 mouth_upper_lip_top
nose_contour_left1 nose_contour_left2 nose_contour_left3 nose_contour_lower_middle nose_contour_right1 nose_contour_right2 nose_contour_right3 nose_left nose_right nose_tip
right_eye_bottom right_eye_center right_eye_left_corner right_eye_lower_left_quarter right_eye_lower_right_quarter right_eye_pupil right_eye_right_corner right_eye_top
right_eye_upper_left_quarter right_eye_upper_right_quarter right_eyebrow_left_corner right_eyebrow_lower_left_quarter right_eyebrow_lower_middle
right_eyebrow_lower_right_quarter right_eyebrow_right_corner right_eyebrow_upper_left_quarter right_eyebrow_upper_middle right_eyebrow_upper_right_quarter
""".split()


def encode(landmark: Column) -> Column:
    """A map of names to points(x, y) as ``x,y;x,y;...`` in the fixed order; null stays null, another number of points is an error, a name that lacks gives an empty point."""
    names = F.array(*[F.lit(n) for n in POINTS])
    # each name is looked up once
    points = F.transform(names, lambda n: F.try_element_at(landmark, n))
    text = F.array_join(F.transform(points, lambda p: F.concat(F.coalesce(p["x"].cast("string"), F.lit("")), F.lit(","), F.coalesce(p["y"].cast("string"), F.lit("")))), ";")
    wrong = F.raise_error(F.lit(f"a landmark has {len(POINTS)} points")).cast("string")
    return F.when(landmark.isNull(), F.lit(None).cast("string")).when(F.size(landmark) == len(POINTS), text).otherwise(wrong)


def decode(text: Column) -> Column:
    """The map of such a text; coordinates are read up to the first character that is no digit, and are null without any."""
    number = lambda p, before: F.nullif(F.regexp_extract(p, before + r"\s*([+-]?\d+)", 1), F.lit("")).cast("long")
    points = F.transform(F.split(text, ";"), lambda p: F.struct(number(p, "^").alias("x"), number(p, "^[^,]*,").alias("y")))
    names = F.array(*[F.lit(n) for n in POINTS])
    return F.when(F.size(F.split(text, ";")) == len(POINTS), F.map_from_arrays(names, points))
