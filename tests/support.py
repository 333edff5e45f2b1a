"""What tests share besides fixtures; a module of its own, as every folder of tests has a conftest."""

import subprocess

# Ships and berths: an enum inside a class, two implementors, a nested type whose name another type has as well.
HARBOUR = {
    "quay/control/TowerController.java": """package org.quay.control;
import org.quay.berth.Berthing;
import org.quay.ship.*;
import java.util.logging.Logger;
public class TowerController {
    private Berthing berthing;
    private static Logger log;
    public String dock(Ship ship) {
        if (!berthing.admit(ship)) { return "wait"; }
        return note(ship);
    }
    private String note(Ship arrived) { log.info("in"); return arrived.callSign(); }
}
""",
    "quay/ship/Ship.java": """package org.quay.ship;
/** What floats. */
public class Ship {
    enum Flag { NORTH, SOUTH; }
    Flag flag; int draught;
    public String callSign() { return flag.name() + draught; }
}
""",
    "quay/berth/Berthing.java": """package org.quay.berth;
import org.quay.ship.Ship;
public interface Berthing { boolean admit(Ship ship); }
""",
    "quay/berth/DeepBerth.java": """package org.quay.berth;
import org.quay.ship.Ship;
class DeepBerth implements Berthing {
    public boolean admit(Ship ship) { return true; }
}
""",
    "quay/berth/TidalBerth.java": """package org.quay.berth;
import java.time.LocalTime;
import org.quay.ship.Ship;
public class TidalBerth implements Berthing {
    static class Slot { LocalTime from; }
    private Slot next = new Slot();
    public boolean admit(Ship ship) { return next.from != null; }
}
""",
    "quay/crane/Slot.java": """package org.quay.crane;
public record Slot(int row, int tier) { }
""",
}


def git(root, *arguments):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *arguments], check=True, capture_output=True)


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
