"""The canonical contract as plain tables. Fixed values all: they must equal the studied system's for equal results.

One row a line, fields between bars, ``-`` for none.
"""

from __future__ import annotations

#: Concept | scope | phase | role | phase system | path template
CONTRACTS = """
rock.compressibility | rock | - | property | - | rock.compressibility
physical.pressure | rock | - | reference | - | rock.reference_pressure
physical.density | fluid_properties | oil | property | - | fluids.oil.density
fluid.pvt | pvt | oil | model | - | fluids.oil.pvt
physical.pressure | pvt | oil | coordinate | - | fluids.oil.pvt.points[{point_index}].pressure
physical.formation_volume_factor | pvt | oil | property | - | fluids.oil.pvt.points[{point_index}].formation_volume_factor
physical.viscosity | pvt | oil | property | - | fluids.oil.pvt.points[{point_index}].viscosity
physical.density | fluid_properties | water | property | - | fluids.water.density
fluid.pvt | pvt | water | model | - | fluids.water.pvt
physical.pressure | pvt | water | coordinate | - | fluids.water.pvt.points[{point_index}].pressure
physical.formation_volume_factor | pvt | water | property | - | fluids.water.pvt.points[{point_index}].formation_volume_factor
physical.viscosity | pvt | water | property | - | fluids.water.pvt.points[{point_index}].viscosity
physical.compressibility | pvt | water | property | - | fluids.water.pvt.points[{point_index}].compressibility
physical.viscosibility | pvt | water | property | - | fluids.water.pvt.points[{point_index}].viscosibility
physical.density | fluid_properties | gas | property | - | fluids.gas.density
fluid.pvt | pvt | gas | model | - | fluids.gas.pvt
physical.pressure | pvt | gas | coordinate | - | fluids.gas.pvt.points[{point_index}].pressure
physical.formation_volume_factor | pvt | gas | property | - | fluids.gas.pvt.points[{point_index}].formation_volume_factor
physical.viscosity | pvt | gas | property | - | fluids.gas.pvt.points[{point_index}].viscosity
physical.water_saturation | relative_permeability | water | coordinate | oil_water | scal.relative_permeability[{table_id}].points[{point_index}].sw
physical.relative_permeability | relative_permeability | water | property | oil_water | scal.relative_permeability[{table_id}].points[{point_index}].krw
physical.relative_permeability | relative_permeability | oil | property | oil_water | scal.relative_permeability[{table_id}].points[{point_index}].kro
physical.capillary_pressure | relative_permeability | - | property | oil_water | scal.relative_permeability[{table_id}].points[{point_index}].pcow
scal.relative_permeability | relative_permeability | - | model | oil_water | scal.relative_permeability[{table_id}]
well | well_controls | - | entity | - | wells[{well_id}].id
well.producer | well_controls | - | type | - | wells[{well_id}].well_type
well.water_injector | well_controls | - | type | - | wells[{well_id}].well_type
well.gas_injector | well_controls | - | type | - | wells[{well_id}].well_type
well.control.liquid_rate | well_controls | - | control | - | wells[{well_id}].controls[liquid_rate].target
well.control.water_injection_rate | well_controls | - | control | - | wells[{well_id}].controls[water_injection_rate].target
well.constraint.minimum_bhp | well_controls | - | constraint | - | wells[{well_id}].controls[liquid_rate].constraints[minimum_bhp].value
well.constraint.maximum_bhp | well_controls | - | constraint | - | wells[{well_id}].controls[{control_type}].constraints[maximum_bhp].value
schedule.duration | schedule | - | duration | - | schedule.duration
schedule.report_interval | schedule | - | report_interval | - | schedule.report_interval
"""

#: Old concept | concept now | scope | phase | role | phase system
LEGACY = """
rock.reference_pressure | physical.pressure | rock | - | reference | -
condition.reference.pressure | physical.pressure | reference_condition | - | reference | -
condition.reference.temperature | physical.temperature | reference_condition | - | reference | -
fluid.oil.density | physical.density | fluid_properties | oil | property | -
fluid.oil.pvt | fluid.pvt | pvt | oil | model | -
fluid.oil.pvt.pressure | physical.pressure | pvt | oil | coordinate | -
fluid.oil.pvt.formation_volume_factor | physical.formation_volume_factor | pvt | oil | property | -
fluid.oil.pvt.viscosity | physical.viscosity | pvt | oil | property | -
fluid.water.density | physical.density | fluid_properties | water | property | -
fluid.water.pvt | fluid.pvt | pvt | water | model | -
fluid.water.pvt.pressure | physical.pressure | pvt | water | coordinate | -
fluid.water.pvt.formation_volume_factor | physical.formation_volume_factor | pvt | water | property | -
fluid.water.pvt.viscosity | physical.viscosity | pvt | water | property | -
fluid.gas.density | physical.density | fluid_properties | gas | property | -
fluid.gas.pvt | fluid.pvt | pvt | gas | model | -
fluid.gas.pvt.pressure | physical.pressure | pvt | gas | coordinate | -
fluid.gas.pvt.formation_volume_factor | physical.formation_volume_factor | pvt | gas | property | -
fluid.gas.pvt.viscosity | physical.viscosity | pvt | gas | property | -
fluid.water.pvt.compressibility | physical.compressibility | pvt | water | property | -
fluid.water.pvt.viscosibility | physical.viscosibility | pvt | water | property | -
scal.relative_permeability.water_saturation | physical.water_saturation | relative_permeability | water | coordinate | oil_water
scal.relative_permeability.krw | physical.relative_permeability | relative_permeability | water | property | oil_water
scal.relative_permeability.kro | physical.relative_permeability | relative_permeability | oil | property | oil_water
scal.relative_permeability.pcow | physical.capillary_pressure | relative_permeability | - | property | oil_water
"""

#: Concepts of one use each, whose missing context is supplied.
DEFAULTS = """
rock.compressibility
scal.relative_permeability
well
well.producer
well.water_injector
well.gas_injector
well.control.liquid_rate
well.control.water_injection_rate
well.constraint.minimum_bhp
well.constraint.maximum_bhp
schedule.duration
schedule.report_interval
"""

#: Control types, and the pattern of each selector.
CONTROL_TYPES = ["liquid_rate", "oil_rate", "water_rate", "gas_rate", "water_injection_rate", "gas_injection_rate", "bhp"]
SELECTORS = {"well_id": r"[\w-]{1,128}", "table_id": r"[\w-]{1,128}", "point_index": "0|[1-9][0-9]*", "control_type": "|".join(CONTROL_TYPES)}


def rows(table: str) -> list[list[str | None]]:
    """The fields of each line of a table."""
    return [[None if field == "-" else field for field in line.split(" | ")] for line in table.strip().splitlines()]
