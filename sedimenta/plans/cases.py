"""Small source files in each language that is cut by symbols, for queries whose result is written down."""

from __future__ import annotations

TIDE_TS = """
import { Buoy } from "./buoy";

export function readTide(station: string): number {
  const note = `closing } in text`;
  return station.length;
}
const forecast = (hours: number[]) => {
  return hours.map((h) => h * 2);
};
let high = 4,
  low = 1;
export class Harbour {
  open() { return true; }
}
export interface Berth { metres: number }
type Port = "north" | "south";
enum Flag { Green, Red }
"""
KETTLE_JS = """
function boil(litres) {
  // the brace } in a comment closes nothing
  return "{" + litres;
}
function* drops() { yield 1; }
var pour = function (cup) { return cup; };
"""
GARDEN_PY = """
import calendar

@calendar_entry
def sow(bed):
    return bed

class Greenhouse:
    @property
    def warmth(self):
        return 21

    class Shelf:
        depth = 3

async def water(can): ...
"""
BROKEN_PY = """
def prune(:
    pass

class Orchard:
    def pick(self):
        return 1

def press():
    return 2
"""
MINT_RS = """
/// A coin of the mint.
#[derive(Clone)]
pub struct Coin<M> { metal: M }

impl<M: Weigh> Coin<M> {
    pub fn strike(metal: M) -> Self { Coin { metal } }
    async fn polish(&self) { let brush = "}"; }
}

impl Weigh for Ingot {
    fn grams(&self) {}
}
enum Alloy { Brass, Bronze }
trait Weigh { fn grams(&self); }
type Tally = u64;
const DIES: usize = 12;
mod vault { pub fn lock() {} }
fn main() { let key = '{'; }
"""
BREWERY_HS = """
module Brewery (mash) where

import qualified Data.Map as Map

-- | Litres of wort that a weight of malt gives.
mash :: Double -> Malt -> Double
mash kilos Pale
  | kilos <= 0 = 0
  | otherwise = kilos * 5.5
mash kilos Roasted = kilos * 4.8

data Malt
  = Pale
  | Roasted
  deriving (Eq)

newtype Cask h = Cask { hold :: [h] }
type Recipe = Map.Map Malt Double

class Vessel v where
  capacity :: v -> Double

instance Vessel (Cask h) where
  capacity = fromIntegral . length . hold

hopRate = 0.7
"""
PRESS_HS = """
module Press where

#ifdef WINDOWS
#if defined(OLD_DRIVER)
instance Printer Matrix where
  feed _ = 3
#endif
#endif

sheets :: Int
sheets = 500
"""
CELLAR_NIX = """
{ stdenv, fetchurl, ... }:
let
  vintage = 1998;
in {
  racks = { upper = 3; };
  labels.front = ''
    year = 1998;
  '';
}
"""
LIBRARY_JAVA = """
package reading.room;

public class Shelf<T> extends Furniture {
  private int boards = 4;
  public Shelf(int boards) { this.boards = boards; }
  @Override
  public <B> List<B> borrow(String title) { if (boards > 0) { return null; } return null; }
  enum Genre { POEM, NOVEL; int pages() { return 80; } }
  interface Reader { void turn(); }
}
record Loan(int days) {}
@interface Rare {}
"""
RAIL_KT = """
package rail

class Wagon(val seats: Int) : Vehicle() {
  val doors = 2
  fun board(): Int = seats + doors
  companion object {
    const val GAUGE = 1435
  }
}
object Depot { fun shunt() {} }
fun depart(track: Int): Int {
  return track
}
val platforms = 9
"""
CLOCK_C = """
#include <gears.h>
#define LARGER(p, q) \\
  ((p) > (q) ? (p) : (q))

/* Winds the spring. */
static long *wind(const char *spring, int turns)
{
  return 0;
}
struct wheel { int teeth; };
union hand { int minute; };
enum chime { HOUR, QUARTER };
typedef struct wheel wheel_t;
typedef void (*strike_fn)(int);
int ticks = 60;
void stop(int hour);
"""
KILN_CPP = """
namespace kiln {
class Oven : public Heater {
public:
  int degrees() const { return 900; }
};
template <typename Clay>
Clay fire(Clay raw) { return raw; }
}
void Oven::cool() {}
extern "C" {
int ash(void) { return 2; }
}
"""
BRIDGE_TEX = r"""
\section{Spans}
Some words on arches.
\begin{figure}
\caption{The old arch}
\end{figure}
\subsection{Loads}
\begin{lemma}\label{lem:keystone}
A keystone holds.
\end{lemma}
\begin{equation}
f = m a
\end{equation}
\[ g \]
"""
SOURCES = {
    1: ("typescript", TIDE_TS), 2: ("javascript", KETTLE_JS), 3: ("python", GARDEN_PY), 4: ("python", BROKEN_PY), 5: ("rust", MINT_RS), 6: ("haskell", BREWERY_HS), 7: ("haskell", PRESS_HS),
    8: ("nix", CELLAR_NIX), 9: ("java", LIBRARY_JAVA), 10: ("kotlin", RAIL_KT), 11: ("c", CLOCK_C), 12: ("cpp", KILN_CPP), 13: ("latex", BRIDGE_TEX), 14: ("go", "package oats"), 15: ("python", None), 16: (None, "plain words"),
    17: ("python", "def first():\n    return 1\n\n" + "".join(f"x{i} = {i}\n" for i in range(300))), 18: ("python", "def stack():\n" + "    crates = 12\n" * 900),
}
#: What they declare: source, name, kind, first and last line.
SYMBOLS = """
    1, readTide, function, 4, 7; 1, forecast, function, 8, 10; 1, high, function, 11, 12; 1, low, function, 11, 12; 1, Harbour, class, 13, 15;
    1, Berth, interface, 16, 16; 1, Port, type, 17, 17; 1, Flag, enum, 18, 18; 2, boil, function, 2, 5; 2, drops, function, 6, 6;
    2, pour, function, 7, 7; 3, sow, function, 4, 6; 3, Greenhouse, class, 8, 14; 3, Greenhouse.warmth, method, 9, 11; 3, water, function, 16, 16;
    4, prune, function, 2, 3; 4, Orchard, class, 5, 7; 4, Orchard.pick, method, 6, 7; 4, press, function, 9, 10; 5, Coin, struct, 2, 4;
    5, Coin::strike, function, 7, 7; 5, Coin::polish, function, 8, 8; 5, Ingot::grams, function, 12, 12; 5, Alloy, enum, 14, 14; 5, Weigh, trait, 15, 15;
    5, Tally, type, 16, 16; 5, DIES, const, 17, 17; 5, lock, function, 18, 18; 5, main, function, 19, 19; 6, mash, function, 6, 11;
    6, Malt, struct, 13, 16; 6, Cask, struct, 18, 18; 6, Recipe, type, 19, 19; 6, Vessel, class, 21, 22; 6, Vessel, impl, 24, 25;
    6, hopRate, function, 27, 27; 7, Printer, impl, 6, 7; 7, sheets, function, 11, 12; 8, vintage, binding, 4, 4; 8, racks, binding, 6, 6;
    8, labels.front, binding, 7, 9; 9, Shelf, class, 4, 11; 9, Shelf.Shelf, constructor, 6, 6; 9, Shelf.borrow, method, 7, 8; 9, Genre, enum, 9, 9;
    9, Genre.pages, method, 9, 9; 9, Reader, interface, 10, 10; 9, Reader.turn, method, 10, 10; 9, Loan, record, 12, 12; 9, Rare, annotation, 13, 13;
    10, Wagon, class, 4, 10; 10, Wagon.doors, property, 5, 5; 10, Wagon.board, method, 6, 6; 10, Wagon.Companion, object, 7, 9; 10, Wagon.Companion.GAUGE, property, 8, 8;
    10, Depot, object, 11, 11; 10, Depot.shunt, method, 11, 11; 10, depart, function, 12, 14; 10, platforms, property, 15, 15; 11, LARGER, const, 3, 4;
    11, wind, function, 6, 10; 11, wheel, struct, 11, 11; 11, hand, struct, 12, 12; 11, chime, enum, 13, 13; 11, wheel_t, type, 14, 14;
    11, strike_fn, type, 15, 15; 12, Oven, class, 3, 6; 12, degrees, function, 5, 5; 12, fire, function, 8, 8; 12, ash, function, 12, 12;
    13, Spans, section, 2, 14; 13, The old arch, figure, 4, 6; 13, Loads, subsection, 7, 14; 13, lem:keystone, lemma, 8, 10; 13, equation@L11, equation, 11, 13;
    17, first, function, 1, 2;
"""
#: Their chunks: source, index, first and last line, kind.
CHUNKS = """
    1, 0, 4, 7, function; 1, 1, 8, 10, function; 1, 2, 11, 12, function; 1, 3, 11, 12, function; 1, 4, 13, 15, class; 1, 5, 16, 16, interface; 1, 6, 17, 17, type; 1, 7, 18, 18, enum;
    2, 0, 2, 5, function; 2, 1, 6, 6, function; 2, 2, 7, 7, function; 3, 0, 4, 6, function; 3, 1, 8, 14, class; 3, 2, 9, 11, method; 3, 3, 16, 16, function; 4, 0, 2, 3, function;
    4, 1, 5, 7, class; 4, 2, 6, 7, method; 4, 3, 9, 10, function; 5, 0, 2, 4, struct; 5, 1, 7, 7, function; 5, 2, 8, 8, function; 5, 3, 12, 12, function; 5, 4, 14, 14, enum;
    5, 5, 15, 15, trait; 5, 6, 16, 16, type; 5, 7, 17, 17, const; 5, 8, 18, 18, function; 5, 9, 19, 19, function; 6, 0, 6, 11, function; 6, 1, 13, 16, struct; 6, 2, 18, 18, struct;
    6, 3, 19, 19, type; 6, 4, 21, 22, class; 6, 5, 24, 25, impl; 6, 6, 27, 27, function; 7, 0, 6, 7, impl; 7, 1, 11, 12, function; 8, 0, 4, 4, binding; 8, 1, 6, 6, binding;
    8, 2, 7, 9, binding; 9, 0, 4, 11, class; 9, 1, 6, 6, constructor; 9, 2, 7, 8, method; 9, 3, 9, 9, enum; 9, 4, 9, 9, method; 9, 5, 10, 10, interface; 9, 6, 10, 10, method;
    9, 7, 12, 12, record; 9, 8, 13, 13, annotation; 10, 0, 4, 10, class; 10, 1, 5, 5, property; 10, 2, 6, 6, method; 10, 3, 7, 9, object; 10, 4, 8, 8, property; 10, 5, 11, 11, object;
    10, 6, 11, 11, method; 10, 7, 12, 14, function; 10, 8, 15, 15, property; 11, 0, 3, 4, const; 11, 1, 6, 10, function; 11, 2, 11, 11, struct; 11, 3, 12, 12, struct; 11, 4, 13, 13, enum;
    11, 5, 14, 14, type; 11, 6, 15, 15, type; 12, 0, 3, 6, class; 12, 1, 5, 5, function; 12, 2, 8, 8, function; 12, 3, 12, 12, function; 13, 0, 2, 14, section; 13, 1, 4, 6, figure;
    13, 2, 7, 14, subsection; 13, 3, 8, 10, lemma; 13, 4, 11, 13, equation; 14, 0, 1, 1, ; 16, 0, 1, 1, ; 17, 0, 1, 2, function; 17, 1, 1, 120, ; 17, 2, 106, 225, ;
    17, 3, 211, 303, ; 18, 0, 1, 120, ; 18, 1, 106, 225, ; 18, 2, 211, 330, ; 18, 3, 316, 435, ; 18, 4, 421, 540, ; 18, 5, 526, 645, ; 18, 6, 631, 750, ;
    18, 7, 736, 855, ; 18, 8, 841, 901, ;
"""


def values(text: str) -> list[tuple[str, ...]]:
    return [tuple(x.strip() for x in row.split(",")) for row in text.replace("\n", " ").split(";") if row.strip()]
