import pytest

from clausewright.operators import units as U
from tests import hostile

TARGETS = U.Targets([("speed", "km/h"), ("acceleration", "m/s^2"), ("length", "m"), ("mass", "kg"), ("time", "s"), ("illumination", "lux"), ("temperature", "°C"), ("force", "N"), ("pressure", "kPa")])


def read(field, value, units=None, *prose):
    return U.read_value(field, value, units or {}, prose, TARGETS)


@pytest.mark.parametrize("field, value, low, foreign", [
    ("Impact speed", "36 km/h", 36, False), ("Impact speed", "10 m/s", 36, True), ("Impact speed", "10 m / s", 36, True), ("Target speed", "$k m / h$", None, None), ("Target speed, $k m / h$", "50", 50, False), ("Approach velocity", "60 mph", 96.56064, True),
    ("Ambient temperature", "300 K", 26.85, True), ("Ambient temperature", "50 °F", 10, True), ("Ambient temperature", "21,5 deg C", 21.5, False), ("Peak deceleration", "1 g", 9.80665, True), ("Mean deceleration", "3.1 m s-2", 3.1, False), ("Mean deceleration", "310 cm/s^2", 3.1, True),
    ("Line pressure", "2.5 bar", 250, True), ("Line pressure", "250 kpa", 250, False), ("Test mass", "1.5 t", 1500, True), ("Ballast [x 100 kg]", "4.7", 470, True), ("Vehicle mass (10³ kg)", "1.2", 1200, True), ("Pedal force in x 10 N", "12", 120, True), ("Warning lead time", "1500ms", 1.5, True),
    ("vut_speed_kmh", "50", 50, False), ("vehicle_mass_lb", "100", 45.359237, True), ("ambient_temp_K", "273.15", 0, True), ("Light at target", "2.1 klx", 2100, True), ("Ambient illumination", "10 foot-candles", 107.639104, True), ("Stopping distance", "12 m.", 12, False),
])
def test_values_come_out_in_the_common_unit(field, value, low, foreign):
    r = read(field, value)
    if low is None:
        assert r is None
    else:
        assert r.low == pytest.approx(low, abs=1e-6) and r.foreign is foreign


def test_order_of_unit_statements():
    assert not read("Line pressure, bar", "250 kPa").foreign  # with the value first
    assert read("Line pressure, bar", "2", {"pressure": "kPa"}).foreign  # then the field
    assert read("Line pressure", "2", {"pressure": "MPa"}, "Limits (line pressure in kPa)").foreign  # then the record's units
    assert read("Line pressure", "2", None, "Limits (line pressure in bar)").foreign
    assert read("peak_decel", "2", None, "Note that accelerations are given in ft/s².").foreign
    assert not read("Line pressure", "2", None, "Limits (tyre pressure in bar)").foreign  # another column's
    assert read("Line pressure", "2", {"pressure": "kg"}).unit_text == "kPa"  # wrong dimensions are passed over


@pytest.mark.parametrize("value", [None, "", " ", "n/a", "—", "not tested", "see note"])
def test_no_value(value):
    assert read("Impact speed", value) is None


def test_ranges_tolerances_and_qualifiers():
    assert read("Impact speed", "10-20 m/s").high == pytest.approx(72)
    r = read("Ambient temperature", "≤ 50 ± 9 °F")
    assert (r.low, r.tolerance) == (pytest.approx(10), pytest.approx(5))
    assert read("Gap at start", "approx. 12,5 *").low == 12.5


def test_other_fields_count_only_with_a_listed_unit():
    assert read("Remark", "2 runs") is None and read("mu", "0.9") is None and read("Row", "3") is None
    assert read("Remark", "20 psi").foreign


def test_dimension_vectors():
    assert U.unit_for("N m / s", (2, 1, -3, 0, 0)).scale == 1
    assert U.unit_for("furlong", U.L) is None
    assert U.unit_for("x" * 100_000, U.L) is None


def test_hostile_tables(tables):
    t, c, u = tables("regulation_tables"), tables("test_cases"), tables("unit_targets")
    found = {tuple(r) for r in U.foreign_units(U.measured_cells(t, c), u).collect()}
    assert found and {tuple(r) for r in U.foreign_units(U.measured_cells(hostile.repeated(t), hostile.repeated(c)), u).collect()} == found
    assert {tuple(r) for r in U.foreign_units(U.measured_cells(hostile.clashing(t), hostile.clashing(c)), hostile.clashing(u)).collect()} == found
    assert found <= {tuple(r) for r in U.foreign_units(U.measured_cells(hostile.with_nulls(t), hostile.with_nulls(c)), hostile.with_nulls(u)).collect()}
    assert U.foreign_units(U.measured_cells(hostile.empty(t), hostile.empty(c)), u).count() == 0
    assert U.converted(U.measured_cells(t, c), hostile.empty(u)).count() == 0


def test_very_long_values_take_linear_time():
    import time

    targets = U.Targets([("speed", "km/h"), ("length", "m")])
    began = time.time()
    for value, foreign in (("5 mph" + " again" * 100_000, True), ("5" + " *" * 200_000, False), ("5 " + "m " * 200_000, False), ("5 km/h" + " " * 300_000, False), ("5 mph " + "*" * 300_000, True)):
        r = U.read_value("speed", value, {}, ("all values of " + "a " * 100_000,), targets)
        assert r is not None and r.foreign == foreign, value[:20]
    assert time.time() - began < 20
