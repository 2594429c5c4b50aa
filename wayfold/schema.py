"""Explicit types of the entities; nothing is inferred, so keyed objects stay maps and absent fields become null."""

from __future__ import annotations

from pyspark.sql.types import StructType

PLACE = "struct<row:int,column:int,heading:string>"
RISK = f"struct<life_lost:boolean,pellets:int,action_frames:int,player:{PLACE}>"

#: One row per decision: the central fact table.
DECISION = f"""
episode_id string, level int, seed int, turn int, life_index int, lives_before int,
player {PLACE}, next_player {PLACE}, score_before long, score_after long, pellets_before int, pellets_after int,
choice string, probabilities map<string,double>, legal_moves array<string>, strata map<string,boolean>,
events struct<normal_pellets:int,power_pellets:int,ghosts_eaten:array<string>,fruit_eaten:int>,
action_frames int, outcome string, http_ms double, immediate_counterfactuals map<string,{RISK}>
"""

#: What a decision was made on. Fields that only the second version of the format has are nullable.
OBSERVATION = """
game string, engine_revision string, maze array<string>, legend map<string,string>,
player struct<row:int,column:int,heading:string,pixel_offset:struct<x:int,y:int>,speed_phase:int,eat_pause_frames:int,stopped:boolean,next_heading:string,queued_heading:string>,
ghosts array<struct<name:string,row:int,column:int,heading:string,mode:string,frightened:boolean,pixel_offset:struct<x:int,y:int>,speed_phase:int,next_heading:string,pending_reverse:boolean,pending_release:boolean>>,
legal_moves array<string>, level int, lives int, score long, pellets_remaining int, frightened boolean, ghost_phase string,
fruit struct<name:string,points:int,row:int,column:int>, turn int, simulation_frames long,
recent_positions array<struct<row:int,column:int,heading:string>>, visits_to_current_tile int, objective string, action_semantics string,
timing struct<power:struct<remaining_frames:int,ghost_points:int,eating_pause_frames:int>,commander:struct<phase_clock_frames:int>,release:struct<mode:string,frames_since_last_dot:int,global_count:int,personal_counts:map<string,int>>,elroy:struct<wait_for_clyde:boolean>,blinky_elroy:int,fruit_remaining_frames:int>,
life_epoch int, decisions_since_last_pellet int, destination_visits map<string,int>
"""

RESPONSE = "choice string, probabilities map<string,double>"

EPISODE_METRICS = """
level int, seed int, level_cleared boolean, outcome string, life_losses int, decisions int, simulation_frames long,
avoidable_immediate_deaths int, avoidable_risk_decisions int, all_immediate_actions_fatal int, loop_decisions int,
longest_loop_streak_decisions int, longest_no_pellet_decisions int, multi_tile_actions int, stationary_actions int,
nonterminal_multi_tile_actions int, nonterminal_stationary_actions int, pellets_remaining int,
per_life map<string,struct<decisions:int,pellets_collected:int,life_lost:boolean>>
"""

RECORD = """
id string, class string, origin string, group_id string, split string, digest string, label string, margin double,
episode string, source_index int, life_index int, cohorts map<string,boolean>, behavior map<string,boolean>,
parent_targeted_id string, learner_disagreement_measured boolean
"""

TELEMETRY = "step int, ce_cum double, n_cum int"
CATALOG = "id string, split string, class string, scenario string, tags array<string>, game string, family string"
MANIFEST = "name string, sha256 string, bytes long, rows long"
EDGE = "src int, dst int"


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(" ".join(ddl.split()))
